"""What the operators of this folder share: scratch tables and whole-text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of a narrow table in one file.
FILE_ROWS = 1_000_000


def files_for(rows: int, least: int = 8) -> int:
    """Files for a narrow table of so many rows at most: few for a small one, and as many as it needs for a large one."""
    return max(least, rows // FILE_ROWS)


def staged(df: DataFrame, name: str, partition_by: str | None = None, files: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor depend on an
    executor's disk.  files bounds the number of files of a table whose size is known, so that a small one does not
    become as many files as there are shuffle partitions.  The files go when the session's JVM ends."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer = writer.option("compression", codec) if codec else writer
    writer.parquet(path)
    gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Spark's switch for deleting a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_alone(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Like staged; the shuffle files of df go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return staged(df, name, codec=codec)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def discard(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Delete path when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def slices(batches, rows: int = 1000):
    """Arrow batches of at most so many rows: whole texts are wide, and what is made from a batch adds to it."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII text takes the fast path; lower() would also change É or ß's kin."""
    ascii_only = F.length(text) == F.octet_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
