"""Exact dedup by content sort.

Texts are equal when they are identical without white space.  Normalised texts are range-partitioned at splitters that
Spark samples from a bounded key (first characters, digest, length, id), sorted outside memory inside each partition,
and every text is compared in full with its neighbour.  As the key ends with length and id, a group of copies of any
size is spread over as many partitions as its bytes need.  Groups that cross partition borders are stitched afterwards:
at most one such group per border exists, so that table is bounded by the number of partitions.

Defined results: null text counts as empty; empty texts form one group; of a group the longest original, then the
smallest id stays; of identical rows that also share their id exactly one is kept; a null id sorts first; extra columns
of any name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import SPACE, staged, whole_text

#: Characters of the normalised text in the range key; the sample that finds the splitters goes to the driver.
KEY_CHARS = 32


def without_space(text: Column) -> Column:
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition.  A run's ids wait until it ends; texts do not."""
    part = TaskContext.get().partitionId()
    first, run = True, None  # run: [ids chunks, digest, keeper's length, text]

    def out(ids, digest, keep, length, size, head, edge):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, digest, keep, length, pa.array(size, pa.int64()), pa.array(head, pa.bool_()), pa.array(np.full(n, edge)), pa.array(np.full(n, part, np.int64))],
            names=["id", "text_sha256", "keep_id", "keep_len", "run_size", "head", "edge", "part"],
        )

    def flush(edge):
        ids = pa.concat_arrays(run[0])
        zeros = np.zeros(len(ids), np.int64)
        head = zeros.astype(bool)
        head[0] = True
        return out(ids, run[1].take(zeros), ids.take(zeros), run[2].take(zeros), zeros + len(ids), head, edge)

    for b in batches:
        ids, length, digest, text = (b.column(i) for i in range(4))
        n = b.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = run is None or run[3] != text[0]
        starts = np.flatnonzero(new)
        until = starts[0] if len(starts) else n
        if until:
            run[0].append(ids.slice(0, until))
        if not len(starts):
            continue
        if run is not None:
            yield flush(first)
            first = False
        sizes = np.diff(np.append(starts, n))
        if len(starts) > 1:
            lo, hi = (starts[0], starts[-1])
            k = 0
            if first and run is None:  # the partition's first run is an edge of its own
                hi0 = starts[1]
                zeros = np.full(hi0 - lo, lo)
                yield out(ids.slice(lo, hi0 - lo), digest.slice(lo, hi0 - lo), ids.take(zeros), length.take(zeros), np.full(hi0 - lo, hi0 - lo), np.arange(hi0 - lo) == 0, True)
                lo, k, first = hi0, 1, False
            if hi > lo:
                at = np.repeat(starts[k:-1], sizes[k:-1])
                yield out(ids.slice(lo, hi - lo), digest.slice(lo, hi - lo), ids.take(at), length.take(at), np.repeat(sizes[k:-1], sizes[k:-1]), new[lo:hi], False)
        s = starts[-1]
        run = [[ids.slice(s)], digest.slice(s, 1), length.slice(s, 1), text[s]]
    if run is not None:
        yield flush(True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("whole")).select("id", F.length("whole").cast("long").alias("n"), without_space(F.col("whole")).alias("norm"))
    rows = rows.select("id", "n", F.sha2("norm", 256).alias("digest"), "norm", F.substring("norm", 1, KEY_CHARS).alias("start"))
    key = ["start", "digest", F.desc("n"), F.asc("id")]
    runs = rows.repartitionByRange(*key).sortWithinPartitions("start", "digest", "norm", F.desc("n"), F.asc("id"))
    schema = T.StructType().add("id", kind).add("text_sha256", "string").add("keep_id", kind).add("keep_len", "long").add("run_size", "long").add("head", "boolean").add("edge", "boolean").add("part", "long")
    marked = staged(runs.select("id", "n", "digest", "norm").mapInArrow(_mark_runs, schema), "exact")
    best = F.struct((-F.col("keep_len")).alias("a"), F.col("keep_id").alias("b"), F.col("part").alias("c"))
    crossing = (
        marked.filter("edge and head").groupBy("text_sha256")
        .agg(F.min(best).alias("best"), F.sum("run_size").alias("size"), F.count("*").alias("runs"))
        .filter("runs > 1")
        .select(F.col("text_sha256").alias("crossing"), F.col("best.b").alias("best_id"), F.col("best.c").alias("best_part"), "size")
    )
    # bounded: at most one group crosses each border between two partitions
    return marked.join(F.broadcast(crossing), F.col("edge") & (F.col("text_sha256") == F.col("crossing")), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("crossing").isNull(), F.col("keep_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("head") & (F.col("crossing").isNull() | (F.col("part") == F.col("best_part")))).alias("kept"),
        "text_sha256",
    )


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, n, digest, norm) of one sorted partition: the first row of each run of equal texts, whether its run
    may go on in another partition, and the partition."""
    part = TaskContext.get().partitionId()
    names = ["row", "id", "n", "digest", "edge", "part"]
    text, held, opening = None, None, True  # the run's text; its first row, which waits as the run may be the last

    def out(b, edge):
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(b.num_rows, edge)), pa.array(np.full(b.num_rows, part, np.int64))], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column(4)
        new = np.ones(b.num_rows, bool)
        new[1:] = ~pc.equal(norm.slice(1), norm.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = held is None or text != norm[0]
        starts = np.flatnonzero(new)
        if len(starts):
            if held is not None:
                yield out(held, opening)
                opening = False
            inner = starts[:-1]
            if opening and len(inner):
                yield out(b.take(pa.array(inner[:1])), True)
                inner, opening = inner[1:], False
            if len(inner):
                yield out(b.take(pa.array(inner)), False)
            held = b.take(pa.array(starts[-1:]))
        text = norm[b.num_rows - 1]
    if held is not None:
        yield out(held, True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies; every column stays.  Whole rows go through the sort, so of each group of equal texts
    exactly one row stays, also where rows share their id or are repeated; nothing is joined by id."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), whole_text(text_col).alias("whole"))
    norm = without_space(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    rows = rows.select("row", "id", F.length("whole").cast("long").alias("n"), without_space(F.col("whole")).alias("norm"))
    rows = rows.select("row", "id", "n", F.sha2("norm", 256).alias("digest"), F.substring("norm", 1, KEY_CHARS).alias("start"))
    rows = rows.repartitionByRange("start", "digest", F.desc("n"), F.asc("id"))  # the text travels once; norm is made again behind the exchange
    rows = rows.withColumn("norm", norm).sortWithinPartitions("start", "digest", "norm", F.desc("n"), F.asc("id"))
    schema = T.StructType().add("row", docs.schema).add("id", kind).add("n", "long").add("digest", "string").add("edge", "boolean").add("part", "long")
    heads = staged(rows.select("row", "id", "n", "digest", "norm").mapInArrow(_first_of_runs, schema), "heads")
    best = heads.filter("edge").groupBy(F.col("digest").alias("b_digest")).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("id").alias("b"), F.col("part").alias("c"))).alias("best"))
    # bounded: two rows a partition
    out = heads.join(F.broadcast(best), F.col("edge") & (F.col("digest") == F.col("b_digest")), "left").filter(~F.col("edge") | (F.col("part") == F.col("best.c")))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
