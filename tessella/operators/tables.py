"""Joins, set operations and keyed writes between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_hits(vector: DataFrame, keyword: DataFrame, key: str = "id", vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Full outer merge of ranked hits (key, score, rank): a missing side scores 0 and ranks after the last."""
    v = vector.select(F.col(key), F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    k = keyword.select(F.col(key), F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    nv, nk = vector.agg(F.count("*").alias("nv")), keyword.agg(F.count("*").alias("nk"))
    both = v.join(k, key, "full_outer").crossJoin(F.broadcast(nv)).crossJoin(F.broadcast(nk))  # one row each
    vs, ks = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    return both.select(
        key, vs.alias("vector_score"), ks.alias("keyword_score"), F.coalesce("vector_rank", F.col("nv") + 1).alias("vector_rank"), F.coalesce("keyword_rank", F.col("nk") + 1).alias("keyword_rank"),
        (vs * vector_weight + ks * keyword_weight).alias("score"),
        F.array_compact(F.array(F.when(F.col("keyword_score").isNotNull(), F.lit("keyword")), F.when(F.col("vector_score").isNotNull(), F.lit("semantic")))).alias("search_sources"),
    )


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "doc_id", hash_col: str = "hash", full: bool = True) -> DataFrame:
    """key, change (created, updated, deleted, unchanged), current_hash, previous_hash in one full outer join; an
    increment (full=False) never means deletion."""
    p = previous.select(F.col(key), F.col(hash_col).alias("previous_hash"), F.lit(True).alias("_p"))
    c = current.select(F.col(key), F.col(hash_col).alias("current_hash"), F.lit(True).alias("_c"))
    change = (
        F.when(F.col("_p").isNull(), "created").when(F.col("_c").isNull(), "deleted")
        .when(F.col("previous_hash").eqNullSafe(F.col("current_hash")), "unchanged").otherwise("updated")
    )
    out = p.join(c, key, "full_outer" if full else "right").select(key, change.alias("change"), "current_hash", "previous_hash")
    return out


def change_summary(changes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    return changes.agg(n("created"), n("updated"), n("deleted"), n("unchanged"), F.count_if(F.col("change") != "unchanged").alias("total_changes"))


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row per key, the first by order; add a unique column last for repeatable results."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key).dropDuplicates(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Non-null columns of patch replace those of old; a key that old lacks is inserted."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in patch.columns if c != key])
    both = old.join(p, key, "full_outer")
    cols = list(dict.fromkeys([*old.columns, *patch.columns]))

    def pick(c: str) -> Column:
        if c == key:
            return F.col(c)
        new = F.col(f"_new_{c}") if c in patch.columns else None
        return (F.coalesce(new, F.col(c)) if c in old.columns else new).alias(c) if new is not None else F.col(c)

    return both.select(*[pick(c) for c in cols])


def resolve_conflicts(old: DataFrame, new: DataFrame, key: str, time_col: str, strategy: str = "latest_wins") -> DataFrame:
    """latest_wins: the newer row per key (the incoming one on a tie); skip: rows of old stay; manual: both stay, with
    conflict marked."""
    if strategy == "skip":
        return old.unionByName(new.join(old.select(key), key, "left_anti"))
    tagged = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    if strategy == "latest_wins":
        return latest(tagged, key, F.desc_nulls_last(time_col), F.desc("_side")).drop("_side")
    if strategy == "manual":
        n = F.count("*").over(Window.partitionBy(key))
        return tagged.withColumn("conflict", n > 1).drop("_side")
    raise ValueError(f"unknown strategy: {strategy}")


def delete_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).dropDuplicates(), key, "left_anti")


def delete_by_query(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds go; an unknown condition keeps its row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def merge_lists(*parts: DataFrame, key: str = "id") -> DataFrame:
    """Lists in order; a row goes if its id, or its content and title, came before."""
    tagged = None
    for i, p in enumerate(parts):
        p = p.withColumn("_list", F.lit(i))
        tagged = p if tagged is None else tagged.unionByName(p, allowMissingColumns=True)
    h = F.md5(F.concat(F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))))
    tagged = tagged.withColumn("_hash", h)
    by_id = latest(tagged.filter(F.col(key).isNotNull()), key, F.asc("_list"), F.asc("_hash")).unionByName(tagged.filter(F.col(key).isNull()))
    return latest(by_id, "_hash", F.asc("_list"), F.asc_nulls_last(key)).drop("_list", "_hash")


def append_until(primary: DataFrame, secondary: DataFrame, column: str, limit: int) -> DataFrame:
    """Values of primary, then those of secondary that are not in it, up to the limit."""
    tagged = primary.select(column, F.lit(0).alias("_o")).unionByName(secondary.select(column, F.lit(1).alias("_o")))
    return tagged.groupBy(column).agg(F.min("_o").alias("_o")).orderBy("_o", column).limit(limit).select(column)


def containing(texts: DataFrame, parts: DataFrame, text_col: str, part_col: str, id_col: str) -> DataFrame:
    """texts joined to parts by id: the keyed form of matching a result to its document by containment."""
    return texts.join(parts, id_col).filter(F.col(text_col).contains(F.col(part_col)))


def page(df: DataFrame, order: list[Column], size: int = 10, offset: int = 0, cap: int = 100) -> DataFrame:
    """A page of ordered rows; size is capped.  Plans as a top-k of offset + size."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(0, min(size, cap)))


def sort_by_field(df: DataFrame, field: str, descending: bool = True, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(field) if descending else F.asc_nulls_last(field), key)


def ranked(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Top k by score with rank from 1.  The window runs over the k rows only."""
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
