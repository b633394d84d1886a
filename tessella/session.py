"""Session factory and test-table loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "tessella", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster sizes come from spark-submit or conf."""
    b = SparkSession.builder.appName(name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back; the files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: A scan of fewer splits than this is spread over all cores; a larger one has enough and is left alone.
FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits: a small file of one row group is one task otherwise, however
    dear the work on its texts.  Filters and column choices still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without zone become timestamps (the session is in UTC), as watermarks need them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages"):
        df = spread(df)
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first line is the title, the rest the content; publish_time spreads ids over 30 days."""
    d = load(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return d.select(
        "doc_id", title.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("content"), "source", F.col("lang").alias("category"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/news/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("publish_time"), "n_chars",
    )


#: The same relation for the SQL side.
ARTICLES_SQL = """articles AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS content, source, lang AS category,
    'https://' || source || '.example/news/' || CAST(doc_id AS VARCHAR) AS url, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS publish_time, n_chars FROM documents)"""
