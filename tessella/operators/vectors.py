"""Vectors: embedding, cosine search, multi-query, approximate search, TF-IDF vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.clean import embedding_text
from tessella.functions.segment import let, tokens, words
from tessella.operators.tables import upsert
from tessella.session import staged

#: So many times the terms asked for are held to look up the second words of pairs.
TIED = 4
#: Rows of a task whose equal ids are added up together.
STRETCH = 1024


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either side has no length or the dimensions differ."""
    n = norm(a) * norm(b)
    return F.when((n > 0) & (F.size(a) == F.size(b)), dot(a, b) / n).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 10, threshold: float | None = None, where: Column | None = None, cap: int = 100) -> DataFrame:
    """id, score: exact cosine top k.  The filter comes before the distance, the query is a literal, and the order and
    limit plan as a per-task top k, so only k rows a task are shuffled."""
    if where is not None:
        df = df.filter(where)
    scored = df.select(F.col(id_col), cosine(F.col(vector_col), literal(query)).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(max(0, min(k, cap)))


def vector_of(df: DataFrame, id_col: str, vector_col: str, doc_id) -> list[float] | None:
    row = df.filter(F.col(id_col) == F.lit(doc_id)).select(vector_col).first()
    return list(row[0]) if row and row[0] is not None else None


def similar_to(df: DataFrame, id_col: str, vector_col: str, doc_id, k: int = 10, threshold: float | None = None) -> DataFrame:
    """Nearest to a stored vector, itself left out; nothing if it is not stored."""
    q = vector_of(df, id_col, vector_col, doc_id)
    if q is None:
        return df.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    return top_k(df, id_col, vector_col, q, k, threshold, F.col(id_col) != F.lit(doc_id))


def combine(queries: list[list[float]], mode: str = "mean") -> list[float]:
    """Mean, maximum or weighted (1 / (i + 1)) mean of query vectors."""
    q = np.array(queries, float)
    if mode == "max":
        return q.max(0).tolist()
    w = np.ones(len(q)) if mode == "mean" else 1 / np.arange(1, len(q) + 1)
    return ((q * w[:, None]).sum(0) / w.sum()).tolist()


def multi_query(df: DataFrame, id_col: str, vector_col: str, queries: list[list[float]], k: int = 10, mode: str = "mean") -> DataFrame:
    return top_k(df, id_col, vector_col, combine(queries, mode), k)


def batch_top_k(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, block: int = 256) -> DataFrame:
    """query_id, id, score for many queries (query_id, query): each task multiplies its blocks of rows with blocks of the
    query matrix and emits its own top k by score, then id, so the shuffle carries k rows per query and block and a
    worker holds `block` x `block` products at a time.  The query set is collected, at most `block` * 100 rows."""
    rows = queries.limit(block * 100 + 1).collect()
    if len(rows) > block * 100:
        raise ValueError("too many queries for one pass; split them")
    ids = np.array([r[0] for r in rows])
    q = np.array([r[1] for r in rows], float)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            v = np.array(b[vector_col].tolist(), float)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            order = np.argsort(b[id_col].to_numpy(), kind="stable")  # a stable sort by score then keeps ties in id order
            v, own = v[order], b[id_col].to_numpy()[order]
            for lo in range(0, len(q), block):
                s = np.hstack([q[lo : lo + block] @ v[i : i + block].T for i in range(0, len(v), block)])
                n = min(k, s.shape[1])
                at = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"query_id": np.repeat(ids[lo : lo + block], n), id_col: own[at.ravel()], "score": np.take_along_axis(s, at, 1).ravel()})

    kind = df.schema[id_col].dataType.simpleString()
    parts = df.select(id_col, vector_col).mapInPandas(run, f"query_id {queries.schema[0].dataType.simpleString()}, {id_col} {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)


def approximate(df: DataFrame, id_col: str, vector_col: str, bucket_length: float = 0.6, tables: int = 8, seed: int = 7):
    """A random projection index over normalised vectors (pyspark.ml); its approxNearestNeighbors answers queries."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    n = norm(F.col(vector_col))
    unit = df.select(F.col(id_col), array_to_vector(F.transform(vector_col, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))).alias("unit"))
    return BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(unit), unit


def adjust_dim(v: Column, dim: int) -> Column:
    """Cut or padded with zeros."""
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim)).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Histogram of hashed words (the first 8 hex digits of md5, so other engines agree), normalised: an embedding that
    needs no model."""
    slots = F.transform(words(embedding_text(text), index=True), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    counts = let(slots, lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(found, lambda s: s == i)).cast("double")))
    return let(counts, unit)


def query_embedding(text: str, dim: int = 64) -> list[float]:
    """A repeatable stand-in vector for a query, on the driver."""
    import hashlib

    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range((dim + 31) // 32))
    v = np.frombuffer(raw, np.uint8)[:dim].astype(float) - 127.5
    return (v / np.linalg.norm(v)).tolist()


def model_embedding(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, failures=None) -> Column:
    """Pluggable model: load() runs once per worker; empty texts give zero vectors.  A failed batch ends the job, unless
    failures, an accumulator of sparkContext.accumulator(0), is given: then its texts get zero vectors and are counted."""
    from collections.abc import Iterator

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in it:
            s = s.fillna("")
            out = np.zeros((len(s), dim))
            full = np.flatnonzero((s != "").to_numpy())
            if len(full):
                try:
                    got = np.asarray(encode(s.iloc[full].tolist()))[:, :dim]
                    out[full, : got.shape[1]] = got
                except Exception:  # noqa: BLE001  counted, where the caller asked for that
                    if failures is None:
                        raise
                    failures.add(len(full))
            yield pd.Series(list(out))

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(embedding_text(text))


def with_cache(df: DataFrame, cache: DataFrame, text_col: str, embed: Callable[[Column], Column]) -> DataFrame:
    """df with embedding: texts whose md5 is in the cache (key, embedding) are joined, only the others are embedded."""
    keyed = df.withColumn("key", F.md5(F.coalesce(text_col, F.lit(""))))
    old = keyed.join(cache.select("key", "embedding"), "key")
    new = keyed.join(cache.select("key"), "key", "left_anti").withColumn("embedding", embed(F.col(text_col)))
    return old.unionByName(new)


def tfidf_vectors(df: DataFrame, id_col: str, text: Column, dim: int = 64, min_df: int = 2, max_df: float = 0.95, bigrams: bool = True):
    """id, tfidf (sparse) over the `dim` commonest one- and two-grams, and the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, SQLTransformer

    base = df.select(F.col(id_col), tokens(text).alias("_w"))
    stages = [NGram(n=2, inputCol="_w", outputCol="_b"), SQLTransformer(statement=f"SELECT {id_col}, {'concat(_w, _b)' if bigrams else '_w'} AS _g FROM __THIS__")]
    stages += [CountVectorizer(inputCol="_g", outputCol="_c", vocabSize=dim, minDF=min_df, maxDF=max_df), IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="tfidf")]
    model = Pipeline(stages=stages).fit(base)
    return model.transform(base).select(id_col, "tfidf"), model


def tfidf_embedding(df: DataFrame, id_col: str, text: Column, dim: int = 64, features: int = 512, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """id, embedding: the sparse vectors of tfidf_vectors() over `features` grams, reduced to `dim` principal
    components; fewer where there are fewer grams."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    sparse, model = tfidf_vectors(df, id_col, text, features, min_df, max_df)
    k = min(dim, len(model.stages[2].vocabulary))
    return PCA(k=k, inputCol="tfidf", outputCol="e").fit(sparse).transform(sparse).select(id_col, vector_to_array("e").alias("embedding"))


def _commonest(terms: DataFrame, k: int) -> list:
    """Rows (term, cf) of the k commonest terms; ties by term."""
    return terms.groupBy("term").agg(F.count("*").alias("cf")).orderBy(F.desc("cf"), "term").limit(k).collect()


def _pairs_of(w: Column, first: list[str], second: list[str] | None) -> Column:
    """Neighbours with a space between them; a word of `first`, then one of `second` (None: any)."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    both = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.when(a.isin(first) & (b.isin(second) if second else F.lit(True)), F.concat_ws(" ", a, b)))
    return F.filter(both, lambda p: p.isNotNull())


def _term_counts(base: DataFrame, id_col: str, features: int, bigrams: bool) -> tuple[list[str], DataFrame]:
    """The `features` commonest terms, and (id, tf: array of ix and n) of the rows of base (id, _w).

    A pair is as common as its rarer word at most, and begins with its first word.  So one that comes before the last of
    the `features` commonest words begins with one of these and ends with a word that is as common as the last of them;
    other pairs are not counted.  Where too many words are as common as the last one, any may be the second."""
    from pyspark.ml.feature import CountVectorizerModel

    held = TIED * features
    words = _commonest(base.select(F.explode("_w").alias("term")), held)
    if not words:
        return [], base.select(id_col, F.expr("CAST(array() AS array<struct<ix: int, n: double>>)").alias("tf")).limit(0)
    first, least = [r["term"] for r in words[:features]], words[features - 1]["cf"] if len(words) >= features else 1
    second = [r["term"] for r in words if r["cf"] >= least] if len(words) < held or words[-1]["cf"] < least else None
    grams = F.filter("_w", lambda t: t.isin(first))
    if bigrams:
        grams = F.concat(grams, _pairs_of(F.col("_w"), first, second))
        vocabulary = [r["term"] for r in _commonest(base.select(F.explode(grams).alias("term")), features)]
    else:
        vocabulary = first
    model = CountVectorizerModel.from_vocabulary(vocabulary, "_g", "_c")
    counted = model.transform(base.select(id_col, grams.alias("_g"))).select(id_col, F.unwrap_udt("_c").alias("_c"))
    tf = F.arrays_zip(F.col("_c.indices").alias("ix"), F.col("_c.values").alias("n")).cast("array<struct<ix: int, n: double>>")
    return vocabulary, counted.select(id_col, tf.alias("tf"))


def _summed(tf: Column) -> Column:
    """Entries of one ix added up."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["ix"] != F.get(s, i - 2)["ix"]))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(s, a)["ix"].alias("ix"), F.aggregate(F.slice(s, a, b - a), F.lit(0.0), lambda n, x: n + x["n"]).alias("n")))

    return let(F.sort_array(tf), runs)


def _one_row_an_id(counts: DataFrame, id_col: str) -> DataFrame:
    """Rows that share an id added up, by stretches of rows first: no task holds all rows of a frequent id."""
    counts = counts.withColumn("_part", F.floor(F.monotonically_increasing_id() / STRETCH))
    for keys in ([id_col, "_part"], [id_col]):
        counts = counts.groupBy(*keys).agg(F.flatten(F.collect_list("tf")).alias("tf")).withColumn("tf", _summed(F.col("tf")))
    return counts


def tfidf_terms(df: DataFrame, id_col: str, text: Column, features: int = 1000, bigrams: bool = True) -> DataFrame:
    """id, term, weight: smooth idf ln((1 + n) / (1 + df)) + 1, rows of unit length, over the commonest terms of at
    least two characters.

    Terms are counted inside the row, so what is written are words, pairs of common words and a staged row a document
    of at most `features` numbers, not the terms of all documents."""
    vocabulary, counts = _term_counts(df.select(F.col(id_col), tokens(text, 2).alias("_w")), id_col, features, bigrams)
    if not vocabulary:
        return counts.select(id_col, F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    counts = staged(counts, "term-counts").filter(F.size("tf") > 0)  # before, the filter would count the terms once more
    if counts.groupBy(id_col).count().agg(F.max("count")).first()[0] > 1:
        counts = staged(_one_row_an_id(counts, id_col), "term-counts")
    holders = {r["ix"]: r["df"] for r in counts.select(F.explode("tf.ix").alias("ix")).groupBy("ix").agg(F.count("*").alias("df")).collect()}
    n = df.count()
    idf = literal([math.log((1 + n) / (1 + holders[i])) + 1 for i in range(len(vocabulary))])
    terms = F.array(*[F.lit(t) for t in vocabulary])
    w = F.transform("tf", lambda x: x["n"] * F.get(idf, x["ix"]))
    rows = let(w, lambda w: let(norm(w), lambda size: F.zip_with("tf", w, lambda x, y: F.struct(F.get(terms, x["ix"]).alias("term"), (y / size).alias("weight")))))
    return counts.select(id_col, F.inline(rows))


def store(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Vector upsert."""
    return upsert(old, new, id_col)
