"""Search specifications compiled to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.display import bold, fragments, keyword_score, normalized_score, snippet
from tessella.functions.segment import query_terms
from tessella.lexicons import ZH_FINANCE, Lexicon
from tessella.operators import aggregates, filters, fulltext, tables, vectors

MODES = ("keyword", "semantic", "hybrid")
SORTS = ("relevance", "time", "popularity")


@dataclass(frozen=True)
class SearchSpec:
    query: str
    mode: str = "keyword"
    page: int = 1
    page_size: int = 10
    sort: str = "relevance"
    filters: dict[str, Any] = field(default_factory=dict)
    highlight: bool = True
    threshold: float = 0.0

    def __post_init__(self):
        if not 1 <= len(self.query) <= 200:
            raise ValueError("query must have 1 to 200 characters")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("page must be at least 1 and page_size 1 to 100")


def _c(df: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def score_keyword(df: DataFrame, query: str, id_col: str = "id", lexicon: Lexicon = ZH_FINANCE, where: Column | None = None) -> DataFrame:
    """id, score: title x 3, summary x 2, content x 1, any query word in keywords + 2.5, an entity equal to the query
    + 2.  A document that matches no clause is out.  where restricts the hits, not the statistics of the index."""
    score = fulltext.multi_field(df, id_col, {"title": (_c(df, "title"), 3.0), "content": (_c(df, "content"), 1.0), "summary": (_c(df, "summary"), 2.0)}, query, lexicon, where=where)
    extra = F.lit(0.0)
    if "keywords" in df.columns:
        extra = extra + F.when(F.coalesce(F.arrays_overlap("keywords", F.array(*[F.lit(w) for w in query.split()])), F.lit(False)), 2.5).otherwise(0.0)
    if "entities" in df.columns:
        extra = extra + F.when(F.coalesce(F.exists("entities", lambda e: e["text"] == query), F.lit(False)), 2.0).otherwise(0.0)
    if not {"keywords", "entities"} & set(df.columns):
        return score.filter("score > 0")
    more = (df if where is None else df.filter(where)).select(F.col(id_col), extra.alias("_x")).filter("_x > 0")
    both = score.join(more, id_col, "full_outer")
    return both.select(id_col, (F.coalesce("score", F.lit(0.0)) + F.coalesce("_x", F.lit(0.0))).alias("score")).filter("score > 0")


def _order(df: DataFrame, sort: str, id_col: str, time_col: str) -> list[Column]:
    if sort == "time" and time_col in df.columns:
        return [F.desc_nulls_last(time_col), F.asc(id_col)]
    if sort == "popularity" and "view_count" in df.columns:
        return [F.desc_nulls_last("view_count"), F.asc(id_col)]
    return [F.desc("score"), *([F.desc_nulls_last(time_col)] if time_col in df.columns else []), F.asc(id_col)]


def search(df: DataFrame, spec: SearchSpec, now: datetime, id_col: str = "id", time_col: str = "publish_time", vector_col: str = "embedding", query_vector: list[float] | None = None, lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """A page of hits: the columns of df without content and vector, score, relevance, snippet and highlights."""
    where = filters.search_filter(spec.filters, now, time_col) if spec.filters else None
    base = df if where is None else df.filter(where)
    pool = spec.page * spec.page_size * 2
    if spec.mode == "keyword":
        hits = score_keyword(df, spec.query, id_col, lexicon, where)
    else:
        q = query_vector or vectors.query_embedding(spec.query)
        near = vectors.top_k(base, id_col, vector_col, q, pool, spec.threshold, cap=pool)
        if spec.mode == "semantic":
            hits = near
        else:
            words = score_keyword(df, spec.query, id_col, lexicon, where).withColumn("score", normalized_score(F.col("score")))
            merged = tables.merge_hits(tables.ranked(near, "score", id_col, pool), tables.ranked(words, "score", id_col, pool), id_col, vector_weight=0.4, keyword_weight=0.6)
            hits = merged.select(id_col, "score", "search_sources")
    found = base.join(hits, id_col)
    out = tables.page(found, _order(found, spec.sort, id_col, time_col), spec.page_size, (spec.page - 1) * spec.page_size)
    terms = [w for w in spec.query.split() if w]
    cols = {"relevance": normalized_score(F.col("score")) if spec.mode == "keyword" else F.least(F.col("score"), F.lit(1.0)), "snippet": snippet(_c(df, "content"), 500)}
    if spec.highlight and terms:
        cols["highlight"] = F.struct(fragments(_c(df, "title"), terms, 150, 1).alias("title"), fragments(_c(df, "content"), terms, 150, 3).alias("content"), fragments(_c(df, "summary"), terms, 100, 1).alias("summary"))
    return out.withColumns(cols).drop(*[c for c in ("content", vector_col) if c in df.columns])


def search_summary(hits: DataFrame) -> DataFrame:
    """total and max_score of scored hits."""
    return hits.agg(F.count("*").alias("total"), F.max("score").alias("max_score"))


def search_facets(df: DataFrame, time_col: str = "publish_time") -> tuple[DataFrame, DataFrame]:
    sizes = {k: n for k, n in aggregates.FACETS.items() if k in df.columns}
    return aggregates.facets(df, sizes), aggregates.date_histogram(df, time_col)


def advanced_search(df: DataFrame, params: dict[str, Any], now: datetime, id_col: str = "id", lexicon: Lexicon = ZH_FINANCE, size: int = 10) -> DataFrame:
    """id, score: every given clause must hold (query over all fields by the best one, title_query x 2, content_query,
    phrase), exclude words must not occur; no clause, no result."""
    title, content = _c(df, "title"), _c(df, "content")
    where = filters.search_filter(params.get("filters") or {}, now)  # of the hits; statistics are of the whole index
    if params.get("exclude_words"):
        where = where & filters.excludes(params["exclude_words"], title, content)
    if params.get("phrase"):
        where = where & filters.phrase(params["phrase"], title, content)
    scores = []
    if params.get("query"):
        scores.append(fulltext.multi_field(df, id_col, {"title": (title, 3.0), "content": (content, 1.0), "summary": (_c(df, "summary"), 2.0)}, params["query"], lexicon, mode="best", fuzzy=params.get("fuzzy", False), where=where))
    if params.get("title_query"):
        scores.append(fulltext.multi_field(df, id_col, {"title": (title, 2.0)}, params["title_query"], lexicon, where=where))
    if params.get("content_query"):
        scores.append(fulltext.multi_field(df, id_col, {"content": (content, 1.0)}, params["content_query"], lexicon, where=where))
    if not scores:
        if not params.get("phrase"):
            return df.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
        scores.append(df.filter(where).select(F.col(id_col), F.lit(1.0).alias("score")))
    out = scores[0].filter("score > 0")
    for s in scores[1:]:
        out = out.join(s.filter("score > 0").withColumnRenamed("score", "_s"), id_col).select(id_col, (F.col("score") + F.col("_s")).alias("score"))
    return out.orderBy(F.desc(F.round("score", 6)), id_col).limit(size)


def semantic_search(df: DataFrame, query_vector: list[float], query: str, k: int = 10, threshold: float = 0.0, payload: dict[str, Any] | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """Top k with bold keywords and a snippet."""
    hits = vectors.top_k(df, id_col, vector_col, query_vector, k, threshold, filters.payload_filter(payload) if payload else None)
    terms = query_terms(query)
    return df.drop(vector_col).join(hits, id_col).withColumns({"highlight": bold(_c(df, "title"), terms), "content": snippet(_c(df, "content"), 200)}).orderBy(F.desc("score"), id_col)


def hybrid_search(df: DataFrame, query_vector: list[float], query: str, k: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, lexicon: Lexicon = ZH_FINANCE, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, vector_score, keyword_score, ranks, score: candidates by vector (2 x k), rescored by keyword occurrences."""
    near = tables.ranked(vectors.top_k(df, id_col, vector_col, query_vector, 2 * k, cap=2 * k), "score", id_col, 2 * k)
    cand = df.join(near.select(id_col), id_col, "left_semi")
    words = cand.select(F.col(id_col), keyword_score(_c(df, "title"), _c(df, "content"), query_terms(query, lexicon)).alias("score")).filter("score > 0")
    merged = tables.merge_hits(near, tables.ranked(words, "score", id_col, 2 * k), id_col, vector_weight, keyword_weight)
    return merged.orderBy(F.desc("score"), id_col).limit(k)


def filter_search(df: DataFrame, payload: dict[str, Any], sort_by: str, descending: bool = True, k: int = 10, id_col: str = "id") -> DataFrame:
    """Filter, then sort, then limit: a true top k of the filtered rows."""
    return tables.sort_by_field(df.filter(filters.payload_filter(payload)), sort_by, descending, id_col).limit(k)


def suggestions(df: DataFrame, query: str, size: int = 5, title: str = "title") -> DataFrame:
    """Title completions, then template suggestions, up to size."""
    from tessella.functions.display import template_suggestions

    own = fulltext.suggest(df, F.col(title), query, size)
    extra = df.sparkSession.createDataFrame([(s,) for s in template_suggestions(query, size)], "suggestion string")
    return tables.append_until(own, extra, "suggestion", size)
