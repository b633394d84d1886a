"""Change detection against snapshots, and the streams that apply changes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import urls
from tessella.operators import tables
from tessella.operators.filters import newer_than
from tessella.schemas import CHANGE_LOG, RAW_DOCUMENTS, SNAPSHOT
from tessella.sources.store import Table


def snapshot_of(docs: DataFrame, now: Column) -> DataFrame:
    """doc_id, hash, ts, url, title (100 characters), source."""
    c = lambda n: F.col(n) if n in docs.columns else F.lit(None).cast("string")
    doc_id = urls.document_id(c("id").cast("string"), c("content_hash"), c("url"), c("title"), c("publish_time"))
    return docs.select(
        doc_id.alias("doc_id"), urls.document_hash(c("title"), c("content"), c("url"), c("publish_time")).alias("hash"),
        F.coalesce(c("publish_time").cast("timestamp"), c("crawl_time").cast("timestamp"), now).alias("ts"), c("url").alias("url"), F.substring(c("title"), 1, 100).alias("title"), c("source").alias("source"),
    )


class ChangeDetector:
    """Full and incremental detection over a snapshot table and a change log.  State is committed by commit(), after
    the sink took the changes, so a failed run is seen again."""

    def __init__(self, spark: SparkSession, path: str, log_rows: int = 100):
        self.spark, self.log_rows = spark, log_rows
        self.snapshot = Table(spark, f"{path}/snapshot", SNAPSHOT, "doc_id")
        self.log = Table(spark, f"{path}/log", CHANGE_LOG, "timestamp")

    def detect(self, docs: DataFrame, now: Column, full: bool = True, since: datetime | None = None) -> DataFrame:
        """doc_id, change, current_hash, previous_hash.  A full run reports deletions; an increment takes documents
        newer than `since` (default: a day before now) and reports only created and updated ones."""
        cur = tables.latest(snapshot_of(docs, now), "doc_id", F.desc("ts"), F.asc("hash"))
        if not full:
            cur = cur.filter(newer_than(F.col("ts"), F.lit(since).cast("timestamp") if since else F.timestamp_add("HOUR", F.lit(-24), now)))
        out = tables.snapshot_diff(self.snapshot.read(), cur, full=full)
        return out if full else out.filter(F.col("change").isin("created", "updated"))

    def commit(self, docs: DataFrame, changes: DataFrame, now: Column, full: bool = True) -> None:
        cur = tables.latest(snapshot_of(docs, now), "doc_id", F.desc("ts"), F.asc("hash"))
        if full:
            self.snapshot.overwrite(cur)
        else:
            self.snapshot.upsert(cur.join(changes.select("doc_id"), "doc_id", "left_semi"))
        entry = tables.change_summary(changes).withColumn("timestamp", now)
        kept = self.log.read().unionByName(entry).orderBy(F.desc("timestamp")).limit(self.log_rows)
        self.log.overwrite(kept)

    def history(self, n: int = 10) -> DataFrame:
        return self.log.read().orderBy(F.desc("timestamp")).limit(n)

    def totals(self) -> DataFrame:
        return self.history(self.log_rows).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("created", "updated", "deleted", "total_changes")])


def apply_changes(docs: DataFrame, changes: DataFrame, target: Table, id_col: str = "id", transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Created and updated documents, joined back to their full rows, are transformed and upserted; deleted ones go."""
    hot = changes.filter(F.col("change").isin("created", "updated")).select(F.col("doc_id").alias(id_col))
    target.upsert(transform(docs.join(hot, id_col, "left_semi")))
    gone = changes.filter(F.col("change") == "deleted").select(F.col("doc_id").alias(target.key))
    if not gone.isEmpty():
        target.delete(gone)


# streams ---------------------------------------------------------------------------------------------------------


def landing(spark: SparkSession, folder: str, schema=RAW_DOCUMENTS, files_per_trigger: int = 100) -> DataFrame:
    """Posted documents as JSON files in a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def dedup_stream(stream: DataFrame, keys: list[str], time_col: str, ttl: str = "30 days") -> DataFrame:
    """First row per key within the time to live; the state of older keys is dropped."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(keys)


def start_upserts(stream: DataFrame, target: Table, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, order: list[Column] | None = None, **trigger):
    """A query that upserts each micro-batch.  A batch that runs twice gives the same table, so delivery is
    effectively exactly once.  trigger: availableNow=True or processingTime='30 minutes'."""

    def write(batch: DataFrame, number: int) -> None:
        target.upsert(tables.latest(transform(batch), target.key, *(order or [F.asc(target.key)])), f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], size: str = "1 day", slide: str | None = None, lateness: str = "1 hour", value: str | None = None) -> DataFrame:
    """Event-time windows: n (and the sum of value) per window and key; rows later than the watermark are dropped."""
    t = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    agg = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return t.groupBy(w.alias("w"), *keys).agg(*agg).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def sessions(stream: DataFrame, time_col: str, keys: list[str], gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    t = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    return t.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


class SyncManager:
    """Registered pull sources with their own interval and high-water mark: idle, running, paused, error, stopped.
    The mark moves only when a run succeeds."""

    def __init__(self, spark: SparkSession, interval: timedelta = timedelta(minutes=30)):
        self.spark, self.interval, self.state = spark, interval, "idle"
        self.sources: dict[str, dict] = {}
        self.runs: list[dict] = []

    def register(self, name: str, fetch: Callable[[SparkSession, datetime], DataFrame], sink: Callable[[DataFrame], None], interval: timedelta | None = None, enabled: bool = True) -> None:
        self.sources[name] = {"fetch": fetch, "sink": sink, "interval": interval or self.interval, "enabled": enabled, "mark": None, "next": None}

    def enable(self, name: str) -> None:
        self.sources[name]["enabled"] = True

    def disable(self, name: str) -> None:
        self.sources[name]["enabled"] = False

    def start(self) -> None:
        self.state = "running"

    def pause(self) -> None:
        self.state = "paused"

    def resume(self) -> None:
        self.state = "running"

    def stop(self) -> None:
        self.state = "stopped"

    def due(self, now: datetime) -> list[str]:
        return [n for n, s in self.sources.items() if s["enabled"] and (s["next"] is None or s["next"] <= now)]

    def tick(self, now: datetime) -> list[str]:
        """Run what is due; an external scheduler calls this."""
        if self.state != "running":
            return []
        return [n for n in self.due(now) if self.sync(n, now)]

    def sync(self, name: str, now: datetime) -> bool:
        s = self.sources[name]
        since = s["mark"] or now - timedelta(hours=24)
        try:
            df = s["fetch"](self.spark, since)
            n = df.count()
            s["sink"](df)
        except Exception as e:  # noqa: BLE001  a failing source must not stop the others
            self.runs.append({"source_id": name, "documents": 0, "errors": 1, "finished": now, "next_sync": now, "error": str(e)[:500]})
            self.state = "error" if self.state == "running" and len(self.sources) == 1 else self.state
            return False
        s["mark"], s["next"] = now, now + s["interval"]
        self.runs.append({"source_id": name, "documents": n, "errors": 0, "finished": now, "next_sync": s["next"], "error": None})
        return True

    def status(self) -> dict:
        return {"state": self.state, "sources": {n: {"enabled": s["enabled"], "mark": s["mark"], "next": s["next"]} for n, s in self.sources.items()}, "runs": len(self.runs), "errors": sum(r["errors"] for r in self.runs)}
