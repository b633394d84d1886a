"""Best-fit packing with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).  Pieces of
equal length are interchangeable, so the plan is made on the histogram of lengths, which has at most `capacity` rows
whatever the corpus: lengths in decreasing order go to the group of equal, partly filled sequences that is best under
every constraint, by the norm of the weighted residual after the placement or by the weighted dot product of demand
and residual.  The plan is a list of intervals (length, ranks, sequences, offset); each piece is ranked inside its
length by a distributed prefix count over hash ranges and looks its place up in the plan.  Nothing but the histogram
reaches the driver, and a length that holds a third of all pieces is ranked in `RANGES` parts.

Defined results: null text counts as empty, so its only token is the closing id 0; only documents of more than
`capacity` tokens are cut, and their first piece is the short one; an empty table gives no rows; rows that share an id
and a length are placed separately in either order; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import staged, whole_text
from tessella.llm._tokens import TOKENIZER, encoder

CAPACITY = 2048
RANGES = 1024


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        close = np.zeros(1, np.uint32)
        for b in batches:
            text = b.column(1)
            for lo in range(0, b.num_rows, 256):
                rows = []
                for i in range(lo, min(lo + 256, b.num_rows)):
                    ids = np.append(encode(text[i].as_py()), close).astype("<u4")
                    n = len(ids)
                    end = n if n <= capacity else (n % capacity or capacity)
                    start = k = 0
                    while start < n:
                        part = ids[start:end]
                        rows.append((i, k, start, end - start, zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
                        start, end, k = end, end + capacity, k + 1
                cols = list(zip(*rows, strict=True))
                arrays = [b.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("whole")).mapInArrow(cut, schema)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, ranks, first sequence, offset): the piece of that length and rank r goes to
    sequence first + r - first rank, at the offset.  Equal sequences are kept as one group, so the work depends on the
    number of distinct lengths, not of pieces."""
    max_docs = max_docs or capacity
    max_cost = max_cost or float(capacity) ** 2
    room = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights)
    first = np.zeros(0, np.int64)  # of each group: first sequence, sequences, residual capacities
    many = np.zeros(0, np.int64)
    left = np.zeros((0, 3))
    plan = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, float(length) ** 2])
        if (need > room).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        count, rank = int(histogram[length]), 0
        while count:
            fits = np.flatnonzero((left >= need).all(1)) if len(left) else []
            if len(fits):
                after = (left[fits] - need) / room * w
                value = (after**2).sum(1) if rule == "norm" else -((need / room * w) * (left[fits] / room * w)).sum(1)
                g = fits[np.argmin(value)]
                held = left[g].copy()
            else:
                g, held = None, room.copy()
            per = int(min(held // need))
            per = min(per, count)
            take = min(count // per, int(many[g]) if g is not None else count)
            at = int(first[g]) if g is not None else bins
            used = capacity - int(held[0])
            for j in range(per):
                plan.append((length, rank, take, at, used + j * length))
                rank += take
            count -= per * take
            if g is None:
                bins += take
            elif many[g] > take:
                first[g] += take
                many[g] -= take
            else:
                keep = np.arange(len(many)) != g
                first, many, left = first[keep], many[keep], left[keep]
            rest = held - per * need
            if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
                first, many, left = np.append(first, at), np.append(many, take), np.vstack([left, rest])
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, tokenizer: str = TOKENIZER, with_ids: bool = False, rule: str = "norm") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(histogram, capacity, max_docs, max_cost, rule=rule)
    places = spark.createDataFrame(plan, "p_length long, p_rank long, p_many long, p_sequence long, p_offset long")
    key = F.xxhash64("id", "piece", "ids_crc32")
    cut = cut.withColumn("key", key).withColumn("range", F.pmod("key", F.lit(RANGES)))
    sums = cut.groupBy("length", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("key", "id", "piece")
    ranked = cut.withColumn("row", F.row_number().over(inside)).join(sums, ["length", "range"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_many"))
    out = ranked.join(F.broadcast(places), here)  # bounded: a few intervals for each of `capacity` lengths
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("p_sequence") + F.col("rank") - F.col("p_rank")).alias("sequence_id"),
        F.col("p_offset").alias("offset"), *(["ids"] if with_ids else []),
    )
