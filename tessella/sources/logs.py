"""Log lines: tailing, parsing, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_lines(df: DataFrame, now: Column | None = None) -> DataFrame:
    """timestamp, service (file name without its ending), level, message of non-blank lines."""
    line = F.col("value")
    stamp = F.try_to_timestamp(F.regexp_extract(line, "^\\[?(\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    level = F.upper(F.regexp_extract(line, "(?i)\\b(error|warn(?:ing)?|info|debug|fatal)\\b", 1))
    service = F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(?:\\.[^.]*)?$", 1) if "service" not in df.columns else F.col("service")
    return df.select(F.coalesce(stamp, now if now is not None else F.current_timestamp()).alias("timestamp"), service.alias("service"), F.nullif(level, F.lit("")).alias("level"), line.alias("message")).filter(F.trim("message") != "")


def read_logs(spark: SparkSession, folder: str, now: Column | None = None) -> DataFrame:
    return parse_lines(spark.read.text(folder), now)


def stream_logs(spark: SparkSession, folder: str):
    """New files of a folder as they come; the checkpoint of the query keeps what was read."""
    return parse_lines(spark.readStream.format("text").load(folder))


def retain(df: DataFrame, max_lines: int, keep: float = 0.8, order: str = "timestamp") -> DataFrame:
    """All lines up to max_lines rows, else the newest share of them.  Lines are ranked inside days and days are added
    up, so no task sorts the whole log."""
    n = df.count()
    if n <= max_lines:
        return df
    limit = int(max_lines * keep)
    day = F.to_date(order)
    days = df.groupBy(day.alias("_d")).agg(F.count("*").alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per day
    days = days.withColumn("_newer", newer).filter(F.col("_newer") < limit)
    x = df.withColumn("_d", day).join(F.broadcast(days), "_d")  # one row per day that stays
    rank = F.row_number().over(Window.partitionBy("_d").orderBy(F.desc(order), "service", "message"))
    return x.withColumn("_r", rank).filter(F.col("_r") + F.col("_newer") <= limit).select(*df.columns)
