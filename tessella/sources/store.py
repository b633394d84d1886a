"""Versioned Parquet tables.  A version is a list of parts, each a folder of rows; one mark a number, created exclusively,
commits it.  A reader sees a whole version or the one before it, a failed write leaves the table as it was, and of two
writers that start from one version the second is told so and tries again on the newer one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import tables
from tessella.schemas import conform

#: So many upserts are kept as parts that are merged on reading; the next one rewrites the table.
DELTAS = 8
RETRIES = 5
#: Batch ids that a version remembers; a stream repeats its last batch only.
BATCHES = 1000


class Conflict(RuntimeError):
    """Another writer committed first."""


class Table:
    """A document, vector, snapshot or log table under one path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", partition_by: list[str] | None = None):
        self.spark, self.path, self.schema, self.key, self.partition_by = spark, path.rstrip("/"), schema, key, partition_by or []

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marks(self) -> list[str]:
        """Names of the version marks, oldest first; a mark without content belongs to a writer that died."""
        fs, p = self._fs(f"{self.path}/_version-*")
        found = fs.globStatus(p)
        return sorted(str(f.getPath().getName()) for f in found if f.getLen()) if found is not None else []

    def _content(self, mark: str) -> dict:
        fs, p = self._fs(f"{self.path}/{mark}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> str | None:
        """The newest version's mark."""
        marks = self._marks()
        return marks[-1] if marks else None

    def _state(self) -> tuple[int, list[list[str]], list[str]]:
        """Number, parts ([folder, kind]) and applied batches of the current version."""
        mark = self.version()
        if mark is None:
            return -1, [], []
        c = self._content(mark)
        return int(mark.split("-")[1]), c["parts"], c["batches"]

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def _merged(self, parts: list[list[str]]) -> DataFrame:
        out = None
        for folder, kind in parts:
            new = self._rows(folder)
            out = new if out is None else out.unionByName(new) if kind == "rows" else tables.upsert(out, new, self.key)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def read(self) -> DataFrame:
        """The current version; an empty table if there is none."""
        return self._merged(self._state()[1])

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        writer = conform(df, self.schema).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, number: int, parts: list[list[str]], batches: list[str]) -> None:
        """Create the mark of that number; Conflict if it exists."""
        fs, p = self._fs(f"{self.path}/_version-{number:012d}")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # noqa: BLE001  the file system's own error class differs
            if fs.exists(p):
                raise Conflict(f"version {number} of {self.path} is taken") from e
            raise
        stream.write(bytearray(json.dumps({"parts": parts, "batches": batches}).encode()))
        stream.close()

    def _change(self, make: Callable[[list[list[str]]], list[list[str]]], batch: str | None = None) -> None:
        """Commit make(parts) on top of the version it was made from; on a conflict, again on the newer one.  A batch that
        the table has taken before changes nothing."""
        for _ in range(RETRIES):
            number, parts, batches = self._state()
            if batch is not None and batch in batches:
                return
            new = make(parts)
            try:
                return self._commit(number + 1, new, (batches + [batch])[-BATCHES:] if batch is not None else batches)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: other writers won {RETRIES} times")

    def overwrite(self, df: DataFrame) -> None:
        folder = self._write(df)
        self._change(lambda parts: [[folder, "rows"]])

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and the folders that only those used."""
        marks = self._marks()
        live = {f for m in marks[-keep:] for f, _ in self._content(m)["parts"]}
        old = [(m, self._content(m)["parts"]) for m in marks[:-keep]]
        for mark, parts in old:
            for name in (mark, *(f for f, _ in parts if f not in live)):
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Add rows as a part of their own; a repeated batch id adds nothing."""
        if batch is not None and batch in self._state()[2]:
            return
        folder = self._write(df)
        self._change(lambda parts: [*parts, [folder, "rows"]], batch)

    # keyed changes
    def upsert(self, new: DataFrame, batch: str | None = None) -> None:
        """Rows of new replace those with their keys: written as a part that reads merge, so the table is rewritten once in
        DELTAS times only."""
        folder = self._write(tables.latest(conform(new, self.schema), self.key, F.asc(self.key)))

        def add(parts: list[list[str]]) -> list[list[str]]:
            out = [*parts, [folder, "upsert"]]
            return [[self._write(self._merged(out)), "rows"]] if len(out) > DELTAS else out

        self._change(add, batch)

    def _rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self._change(lambda parts: [[self._write(change(self._merged(parts))), "rows"]])

    def update(self, patch: DataFrame) -> None:
        self._rewrite(lambda old: tables.partial_update(old, patch, self.key))

    def delete(self, ids: DataFrame) -> None:
        self._rewrite(lambda old: tables.delete_by_id(old, ids, self.key))

    def delete_where(self, condition: Column) -> None:
        self._rewrite(lambda old: tables.delete_by_query(old, condition))

    def truncate(self) -> None:
        self.overwrite(self.spark.createDataFrame([], self.schema))

    # reads
    def get(self, doc_id) -> DataFrame:
        return self.read().filter(F.col(self.key) == F.lit(doc_id))

    def exists(self, doc_id) -> bool:
        return not self.get(doc_id).isEmpty()

    def count(self, condition: Column | None = None) -> int:
        df = self.read()
        return (df if condition is None else df.filter(condition)).count()

    def list(self, condition: Column | None = None, size: int = 10, offset: int = 0) -> DataFrame:
        df = self.read()
        return tables.page(df if condition is None else df.filter(condition), [F.asc(self.key)], size, offset)

    # upkeep
    def compact(self, rows_a_file: int = 1_000_000) -> None:
        """Rewrite the table as one part, with as many files as its rows need."""
        self._rewrite(lambda old: old.repartition(max(1, -(-old.count() // rows_a_file))))

    def view(self, name: str, condition: Column | None = None) -> None:
        """An alias, filtered or not."""
        df = self.read()
        (df if condition is None else df.filter(condition)).createOrReplaceTempView(name)

    def stats(self) -> dict:
        df = self.read()
        return {"path": self.path, "version": self.version(), "rows": df.count(), "columns": len(self.schema), "files": len(df.inputFiles())}

    def backup(self, to: str) -> None:
        """Rows and schema to another folder."""
        self.read().write.mode("overwrite").parquet(f"{to}/rows")
        self.spark.createDataFrame([(self.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{to}/schema")

    def restore(self, of: str) -> None:
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{of}/schema").first()[0]))
        self.overwrite(self.spark.read.schema(schema).parquet(f"{of}/rows"))


def union_view(name: str, *parts: Table) -> None:
    """An alias over several tables."""
    out = parts[0].read()
    for p in parts[1:]:
        out = out.unionByName(p.read(), allowMissingColumns=True)
    out.createOrReplaceTempView(name)


def routed(df: DataFrame) -> DataFrame:
    """df with index_name by category."""
    return df.withColumn("index_name", F.when(F.col("category") == "news", "news").when(F.col("category") == "announcement", "announcement").otherwise("general"))


def write_routed(df: DataFrame, path: str) -> None:
    routed(df).write.mode("append").partitionBy("index_name").parquet(path)


def gateway_documents(df: DataFrame) -> DataFrame:
    """The short index form: title and content are mandatory, a missing summary is the first 200 characters."""
    ok = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != "")
    return df.filter(ok).select("id", "title", "content", F.substring("content", 1, 200).alias("summary"), "source", "url", F.col("publish_time").alias("published_at"), "tags", F.lit(0).alias("view_count"))


def ingest_fields(df: DataFrame, now: Column) -> DataFrame:
    """processed_time, word_count (length / 5) and reading_time (at least one minute at 250 words); content_raw goes."""
    words = F.floor(F.length("content") / 5).cast("int")
    return df.withColumns({"processed_time": now, "word_count": words, "reading_time": F.greatest(F.lit(1), F.round(words / 250).cast("int"))}).drop("content_raw")


_LOADERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, load: Callable[[SparkSession], DataFrame]) -> None:
    """A named source of documents for pulls."""
    _LOADERS[name] = load


def pull(spark: SparkSession, name: str) -> DataFrame:
    return _LOADERS[name](spark)


def sources() -> list[str]:
    return sorted(_LOADERS)
