"""Mixing sources to target weights, in DataFrame operators only.

Each document gets a hash-random key (md5 of its id, so reruns and other engines agree).  Keys are uniform, so equal
key ranges are even: within each source documents are split by key range, sorted inside each range, and token counts
are summed to range totals, then to range offsets, then to running sums: a distributed prefix sum in which no task
holds a whole source.  The number of ranges follows the number of rows; the result does not depend on it.  Each source
is cut at its exact budget; a budget above the source's size repeats whole epochs.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating; together they get `share` of all words; a
target stops at `most` times its source's words and the excess goes to the others by weight.  That fixed point is
target = min(cap, level * weight), and the level follows from sorting the sources by cap / weight.

Defined results: null or empty text has size 0 and takes 0; an empty table gives no rows; a source without words has
target 0; each row counts, also where rows share an id; rows with equal id and size are interchangeable; a row with a
null id is keyed by its text; extra columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import WORD, staged, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Key ranges per source, as leading hex digits of the key: 3 digits are 4,096 ranges; a digit more for each 16-fold
#: of this many rows.
RANGE_DIGITS, RANGE_ROWS = 3, 4096 * 10_000


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: src, source_size, target.  The windows run over one row per source."""
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("src")))).withColumn("weight", w)
    by = by.withColumn("cap", (most * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    full = F.col("level") * F.col("weight") > F.col("cap")
    level = F.min(F.when(full, None).otherwise(F.struct("cap_by", "rank", "level"))).over(everything)["level"]
    by = by.withColumn("cap_by", F.col("cap") / F.col("weight")).withColumn("at", level)
    return by.select("src", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """id, src, size, unnamed (of a null id the md5 of its text) and more."""
    whole = whole_text(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), count_words(whole).alias("size"), F.when(F.col(id_col).isNull(), F.md5(whole)).alias("unnamed"), *more)


def _taken(rows: DataFrame, sizes: DataFrame, weights, share: float, most: int) -> DataFrame:
    """rows (as measured) with source_size, target, taken.  sizes: the same rows, stored."""
    goal = targets(sizes, weights, share, most).withColumnRenamed("src", "g_src")
    digits, many = RANGE_DIGITS, sizes.count()
    while many > RANGE_ROWS * 16 ** (digits - RANGE_DIGITS):
        digits += 1
    key = F.coalesce("unnamed", F.md5(F.col("id").cast("string")))
    by_range = sizes.groupBy("src", F.substring(key, 1, digits).alias("range")).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select(F.col("src").alias("o_src"), F.col("range").alias("o_range"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.withColumn("key", key).withColumn("range", F.substring("key", 1, digits))
    inside = Window.partitionBy("src", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, rows["src"].eqNullSafe(offsets["o_src"]) & (rows["range"] == offsets["o_range"]))
    rows = rows.join(goal, rows["src"].eqNullSafe(goal["g_src"]))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - whole * F.col("source_size") - F.col("offset") - F.col("run")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), and src."""
    sizes = staged(_measured(docs, id_col, text_col, source_col), "sizes")
    return _taken(sizes, sizes, weights, share, most).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "src")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs as the mix takes them: a row comes as often as it is taken whole; the one that a budget cuts also comes once
    with its first words only.  Every column stays; n_chars, if there, follows the text.  Whole rows go through the
    prefix sums, so each gets its own share and nothing is joined by id."""
    sizes = staged(_measured(docs, id_col, text_col, source_col), "sizes")
    rows = _measured(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _taken(rows, sizes, weights, share, most).filter("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("row", F.explode(copies).alias("first"))
    text = F.col("row")[text_col]
    # the separators of the text's first n words are those of the text itself
    words = F.regexp_extract_all(text, F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    cut = F.when(F.col("first") > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("first"), F.lit(1))), "")).otherwise(text)
    rows = rows.withColumn("cut", cut)
    put = {text_col: F.col("cut")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("first") > 0, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
