"""Line dedup with levelled sorted runs, in DataFrame operators only.

State is a set of runs: bucketed tables of (key hash, owner), sorted by hash inside each bucket.  A batch of documents
is reduced to its distinct line keys before it is shuffled; those are merged against the runs bucket by bucket (the
runs are not shuffled again); keys that no run holds form the batch's own run.  When a level has `FAN` runs they are
merged into one run of the next level, so a key is rewritten once per level.

A key is a line without white space at both ends and with A-Z lower-cased; only keys of `MIN_CHARS` code points count.
Keys are compared as two independent 64-bit hashes.  The owner is the smallest document that holds a key, so a whole
table is fed as `BATCHES` ascending id ranges; a stream of later batches keeps the first holder.

Skew: keys of more than a partition's share of a batch's lines (of 1/1000 where there are fewer partitions; so there are
fewer such keys than partitions, or than 1000) are resolved by a broadcast join, so a line held by a third of all
documents never meets in one task, and no other key has more lines than an average task.

Defined results: null or empty text is one empty line; lines of a document that owns their key all stay; rows that
share id and text get the same result; a null id is a document of its own that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import SPACE, gone_at_exit, lower_ascii, scratch_root, staged, whole_text

MIN_CHARS = 10
BATCHES = 4
FAN = 3
HEAVY_SHARE = 1000


class LineRuns:
    """The levelled runs of one session.  add() takes first holders of a batch, returns the table that resolves it."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, df: DataFrame, what: str) -> str:
        name = f"{self.name}_{what}_{len(self.tables)}"
        self.tables.append(name)
        path = f"{scratch_root(self.spark)}/{self.spark.sparkContext.applicationId}/{name}"
        df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        gone_at_exit(self.spark, path)
        return name

    def runs(self) -> DataFrame | None:
        names = [n for level in self.levels for n in level]
        out = None
        for n in names:
            run = self.spark.table(n).filter("fresh").select("h1", "h2", "owner")
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, first: DataFrame) -> DataFrame:
        """first: h1, h2, owner (smallest holder in the batch), holders.  Returns h1, h2, owner, holders, fresh, where
        owner is the first holder over all batches and fresh marks keys that the batch brought."""
        resolved = first.withColumn("fresh", F.lit(True))
        for level in self.levels:
            for n in level:
                run = self.spark.table(n).filter("fresh").select("h1", "h2", F.col("owner").alias("earlier"))
                resolved = resolved.join(run, ["h1", "h2"], "left").select(
                    "h1", "h2", F.coalesce("earlier", "owner").alias("owner"), "holders", (F.col("fresh") & F.col("earlier").isNull()).alias("fresh")
                )
        name = self._write(resolved, "batch")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()
        return self.spark.table(name)

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fan:
                continue
            merged = None
            for n in self.levels[k]:
                run = self.spark.table(n).filter("fresh")
                merged = run if merged is None else merged.unionByName(run)
            if len(self.levels) == k + 1:
                self.levels.append([])
            self.levels[k + 1].append(self._write(merged, f"level{k + 1}"))
            self.levels[k] = []

    def drop(self) -> None:
        for n in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")


def line_keys(text: Column) -> Column:
    """array<struct<h1, h2>> along the lines of a text; null where a line is too short to count."""

    def key(line: Column) -> Column:
        line = F.btrim(line, F.lit(SPACE))
        return F.when(F.length(line) >= MIN_CHARS, F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")))

    return F.transform(F.split(lower_ascii(text), "\n"), key)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """id, fp, lost: for each document that loses lines, their positions from 0.  fp is the hash of its text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("whole"))
    cuts = rows.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = sum([F.when(F.col("id") > c, 1).otherwise(0) for c in sorted(set(cuts))], F.lit(0))
    lines = rows.select("id", F.xxhash64("whole").alias("fp"), F.posexplode(line_keys(F.col("whole"))).alias("pos", "key")).filter("key is not null")
    lines = staged(lines.select("id", "fp", "pos", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), batch.alias("batch")), "lines", "batch")
    runs = LineRuns(spark)
    try:
        return _lost(lines, runs, len(set(cuts)) + 1)
    finally:
        runs.drop()


def _lost(lines: DataFrame, runs: LineRuns, batches: int) -> DataFrame:
    out = None
    for i in range(batches):
        part = lines.filter(F.col("batch") == i)
        holder = F.struct("id")  # a struct, so that a null id is smallest
        first = part.groupBy("h1", "h2").agg(F.min(holder).alias("owner"), F.count("*").alias("holders"), F.max(holder).alias("last"))
        # holders > 0 marks keys with at least two holders in the batch; one holder's repeats do not count
        first = first.select("h1", "h2", "owner", F.when(F.col("owner") == F.col("last"), -F.col("holders")).otherwise(F.col("holders")).alias("holders"))
        found = runs.add(first).filter("holders > 0 or not fresh").withColumn("n", F.abs("holders"))
        most = part.count() / max(HEAVY_SHARE, runs.buckets)
        heavy = found.filter(F.col("n") > most).select("h1", "h2", "owner")
        light = found.filter(F.col("n") <= most).select("h1", "h2", "owner")
        loses = F.col("owner") != F.struct("id")
        for some in (F.broadcast(heavy), light):  # heavy: fewer keys than HEAVY_SHARE or than partitions
            lost = part.join(some, ["h1", "h2"]).filter(loses).select("id", "fp", "pos")
            out = lost if out is None else out.unionByName(lost)
    return staged(out.dropDuplicates().groupBy("id", "fp").agg(F.collect_list("pos").alias("lost")), "lost")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per document: id_col, kept_text, n_lines, n_dropped."""
    lost = dropped_lines(docs, id_col, text_col, batches).select(F.col("id").alias("l_id"), F.col("fp").alias("l_fp"), "lost")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("whole"))
    rows = rows.select("id", F.xxhash64("whole").alias("fp"), F.split("whole", "\n").alias("lines"))
    both = rows.join(lost, (rows["fp"] == lost["l_fp"]) & rows["id"].eqNullSafe(lost["l_id"]), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(F.col("lines"), i)), "\n"))
    return both.select(
        F.col("id").alias(id_col), kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
