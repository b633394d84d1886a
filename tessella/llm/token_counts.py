"""Token counts as an exact length histogram.

Each document is encoded where it lies and only its length leaves the task; lengths are pre-aggregated before the
shuffle, so the histogram has one row per distinct length whatever the corpus.  Suffix sums over the histogram then
answer totals, quantiles and truncated totals for every context limit.  They are taken in two levels (inside blocks of
lengths, then over block totals), so no task holds the whole histogram.

Defined results: null or empty text has length 0; an empty table gives an empty histogram; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import staged, whole_text
from tessella.llm._tokens import TOKENIZER, encoder

BLOCK = 1024


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document: id_col, n_tokens."""
    schema = T.StructType().add(id_col, docs.schema[id_col].dataType).add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            text = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(text[i].as_py())) for i in range(b.num_rows)], pa.int64())], names=schema.names)

    return docs.select(F.col(id_col), whole_text(text_col).alias("whole")).mapInArrow(count, schema)


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """length, n_docs: one row per distinct length, written once, as its readers go over it twice."""
    only = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    return staged(token_lengths(only, "id", "text", tokenizer).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths", files=8)


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L: length, n_docs, n_tokens (of documents of that length), docs_up_to, docs_longer,
    tokens_up_to, truncated_total (tokens kept if every document is cut at L) and quantile (share of documents not
    longer).  For a limit between two rows, truncated_total grows by docs_longer of the lower row per token."""
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row per BLOCK lengths
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("d_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    h = h.join(blocks, "block").withColumn("docs_longer", F.col("d_in") + F.col("d_above")).withColumn("longer_tokens", F.col("t_in") + F.col("t_above"))
    return h.select(
        "length", "n_docs", "n_tokens", (F.col("docs") - F.col("docs_longer")).alias("docs_up_to"), "docs_longer",
        (F.col("tokens") - F.col("longer_tokens")).alias("tokens_up_to"),
        (F.col("tokens") - F.col("longer_tokens") + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("docs") - F.col("docs_longer")) / F.col("docs")).alias("quantile"),
    )
