"""Full-text search: analysis, postings, BM25, multi-field queries, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.segment import words, words_of
from tessella.lexicons import ZH_FINANCE, Lexicon

K1, B = 1.2, 0.75


def synonym_map(lexicon: Lexicon) -> dict[str, str]:
    """Each lower-cased synonym to the first word of its group."""
    return {w.lower(): g.split(",")[0].lower() for g in lexicon.synonyms for w in g.split(",")}


def analyze(text: Column, lexicon: Lexicon = ZH_FINANCE, stop: bool = True, index: bool = True) -> Column:
    """Words, lower-cased, with synonyms folded and, for the index side, stopwords dropped."""
    found = synonym_map(lexicon)
    out = words(text, lexicon, index)
    if found:
        table = F.create_map(*[F.lit(x) for kv in found.items() for x in kv])
        out = F.transform(out, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.filter(out, lambda t: ~t.isin([w.lower() for w in lexicon.index_stopwords])) if stop and lexicon.index_stopwords else out


def query_tokens(query: str, lexicon: Lexicon = ZH_FINANCE, stop: bool = False) -> list[str]:
    """The same analysis of a query string, on the driver; known words stay whole."""
    found = synonym_map(lexicon)
    folded = [found.get(w, w) for w in words_of(query, lexicon)]
    return list(dict.fromkeys(w for w in folded if not stop or w not in lexicon.index_stopwords))


def postings(df: DataFrame, id_col: str, fields: dict[str, Column], lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """id, field, term, tf, pos: one row per document, field and term, sorted positions."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), analyze(c, lexicon).alias("terms")) for f, c in fields.items()])
    t = df.select(F.col(id_col), F.explode(parts).alias("f")).select(id_col, "f.field", F.posexplode("f.terms").alias("p", "term"))
    return t.groupBy(id_col, "field", "term").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("p")).alias("pos"))


def field_lengths(df: DataFrame, id_col: str, fields: dict[str, Column], lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """id and the number of terms of each field."""
    return df.select(F.col(id_col), *[F.size(analyze(c, lexicon)).alias(f) for f, c in fields.items()])


def _forms(lexicon: Lexicon, terms: list[str]) -> dict[str, list[str]]:
    """Of each term the words that fold to it."""
    found = synonym_map(lexicon)
    return {t: [w for w in dict.fromkeys([t, *(w for w, v in found.items() if v == t)]) if found.get(w, w) == t] for t in terms}


def _one_of(values: list[str]):
    return lambda t: t.isin(values) if values else F.lit(False)


def counted(df: DataFrame, id_col: str, fields: dict[str, Column], terms: list[str], lexicon: Lexicon = ZH_FINANCE, *keep: Column) -> DataFrame:
    """id, keep and of each field i its length _dl{i} and its words that fold to one of the terms, _h{i}.  The words are
    taken once; synonyms are folded on the query's side, so each word is looked up in two sets and not in a map."""
    found = synonym_map(lexicon)
    stop = [w.lower() for w in lexicon.index_stopwords]
    dropped = sorted({w for w in {*stop, *found} if found.get(w, w) in stop})
    wanted = [w for w in dict.fromkeys(w for ws in _forms(lexicon, terms).values() for w in ws) if w not in dropped]
    a = df.select(F.col(id_col), *keep, *[words(c, lexicon, True).alias(f"_w{i}") for i, c in enumerate(fields.values())])
    length = lambda i: F.size(F.filter(f"_w{i}", lambda t: ~t.isin(dropped))) if dropped else F.size(f"_w{i}")
    return a.select(*[c for c in a.columns if not c.startswith("_w")], *[length(i).alias(f"_dl{i}") for i in range(len(fields))], *[F.filter(f"_w{i}", _one_of(wanted)).alias(f"_h{i}") for i in range(len(fields))])


def frequencies(hits: DataFrame, n_fields: int, terms: list[str], lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """hits of counted() with the frequency _tf{i}_{j} of term j in field i."""
    forms = _forms(lexicon, terms)
    return hits.withColumns({f"_tf{i}_{j}": F.size(F.filter(f"_h{i}", _one_of(forms[t]))) for i in range(n_fields) for j, t in enumerate(terms)}).drop(*[f"_h{i}" for i in range(n_fields)])


def statistics(tf: DataFrame, n_fields: int, n_terms: int) -> DataFrame:
    """One row: documents _n, mean lengths _avg{i}, document frequencies _df{i}_{j}."""
    return tf.agg(F.count("*").alias("_n"), *[F.avg(f"_dl{i}").alias(f"_avg{i}") for i in range(n_fields)], *[F.count_if(F.col(f"_tf{i}_{j}") > 0).alias(f"_df{i}_{j}") for i in range(n_fields) for j in range(n_terms)])


def bm25_score(i: int, n_terms: int, k1: float = K1, b: float = B) -> Column:
    """BM25 of field i over rows of frequencies() with the row of statistics()."""
    score = F.lit(0.0)
    for j in range(n_terms):
        tf, df_ = F.col(f"_tf{i}_{j}"), F.col(f"_df{i}_{j}")
        idf = F.log(1 + (F.col("_n") - df_ + 0.5) / (df_ + 0.5))
        score = score + F.when(tf > 0, idf * tf / (tf + k1 * (1 - b + b * F.col(f"_dl{i}") / F.col(f"_avg{i}")))).otherwise(0.0)
    return score


def field_scores(df: DataFrame, id_col: str, fields: dict[str, Column], terms: list[str], lexicon: Lexicon = ZH_FINANCE, where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """id and the BM25 score of each field for documents with at least one term in one of them.

    A query has few terms, so this needs no postings: one pass counts them in all fields, one aggregate of a single row
    gives the statistics, and that row is broadcast back.  where restricts the hits; the statistics are of all of df,
    as in an index."""
    if not terms:
        return df.select(F.col(id_col), *[F.lit(0.0).alias(f) for f in fields]).limit(0)
    n, m = len(fields), len(terms)
    keep = [F.coalesce(where, F.lit(False)).alias("_in")] if where is not None else []
    tf = frequencies(counted(df, id_col, fields, terms, lexicon, *keep), n, terms, lexicon)
    hit = tf.filter(" or ".join(f"_tf{i}_{j} > 0" for i in range(n) for j in range(m)))
    hit = (hit.filter("_in") if keep else hit).crossJoin(F.broadcast(statistics(tf, n, m)))  # one row
    return hit.select(id_col, *[bm25_score(i, m, k1, b).alias(f) for i, f in enumerate(fields)])


def bm25(df: DataFrame, id_col: str, text: Column, terms: list[str], lexicon: Lexicon = ZH_FINANCE, k1: float = K1, b: float = B, where: Column | None = None) -> DataFrame:
    """id, score of documents with at least one term."""
    return field_scores(df, id_col, {"score": text}, terms, lexicon, where, k1, b)


def bm25_from_postings(post: DataFrame, lengths: DataFrame, id_col: str, field: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """The same score from a stored postings table: the scan reads the query's terms only (pushed filters)."""
    p = post.filter((F.col("field") == field) & F.col("term").isin(terms))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg(field).alias("avgdl"))
    x = p.join(F.broadcast(df), "term").join(lengths.select(id_col, F.col(field).alias("dl")), id_col).crossJoin(F.broadcast(stats))  # df: one row per query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return x.groupBy(id_col).agg(F.sum(one).alias("score"))


def multi_field(df: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], query: str, lexicon: Lexicon = ZH_FINANCE, mode: str = "sum", fuzzy: bool = False, where: Column | None = None) -> DataFrame:
    """id, score: per field BM25 times its boost, summed or, for best fields, the maximum.  fuzzy widens the terms by
    edit distance over the term dictionary (0 up to two letters, 1 up to five, else 2)."""
    terms = query_tokens(query, lexicon)
    if fuzzy:
        terms = fuzzy_terms(df, [c for c, _ in fields.values()], terms, lexicon)
    scores = field_scores(df, id_col, {f"_{f}": c for f, (c, _) in fields.items()}, terms, lexicon, where)
    cols = [F.col(f"_{f}") * boost for f, (_, boost) in fields.items()]
    return scores.select(id_col, (sum(cols, F.lit(0.0)) if mode == "sum" else F.greatest(*cols, F.lit(0.0))).alias("score"))


def gateway_search(df: DataFrame, query: str, id_col: str = "id", lexicon: Lexicon = ZH_FINANCE, where: Column | None = None, fuzzy: bool = True) -> DataFrame:
    """id, score by the best of title x 3, content x 1, summary x 2 and tags x 1.5, with fuzzy terms."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ") if "tags" in df.columns else F.lit("")
    return multi_field(df, id_col, {"title": (have("title"), 3.0), "content": (have("content"), 1.0), "summary": (have("summary"), 2.0), "tags": (tags, 1.5)}, query, lexicon, "best", fuzzy, where)


def fuzzy_candidates(df: DataFrame, columns: list[Column], terms: list[str], lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """query_term, term, distance from the term dictionary of the columns."""
    found = df.select(F.explode(F.array_distinct(F.flatten(F.array(*[analyze(c, lexicon) for c in columns])))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    near = F.array(*[F.struct(F.lit(t).alias("q"), F.levenshtein("term", F.lit(t), 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2).alias("d")) for t in terms])
    x = found.select("term", "df", F.explode(near).alias("e")).filter("e.d >= 0")
    return x.select(F.col("e.q").alias("query_term"), "term", F.col("e.d").alias("distance"), "df")


def fuzzy_terms(df: DataFrame, columns: list[Column], terms: list[str], lexicon: Lexicon = ZH_FINANCE, expansions: int = 50) -> list[str]:
    """The query terms with at most `expansions` nearest dictionary terms each, as search engines bound them."""
    c = fuzzy_candidates(df, columns, terms, lexicon)
    rank = F.row_number().over(Window.partitionBy("query_term").orderBy("distance", F.desc("df"), "term"))
    found = c.withColumn("r", rank).filter(F.col("r") <= expansions).select("term").collect()
    return list(dict.fromkeys([*terms, *sorted(r["term"] for r in found)]))


def _own_terms(df: DataFrame, id_col: str, doc_id, text: Column, lexicon: Lexicon, least_tf: int) -> dict[str, int]:
    """The terms of one document and their frequencies; the filter comes first."""
    own = df.filter(F.col(id_col) == F.lit(doc_id)).select(F.explode(analyze(text, lexicon)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    return {r["term"]: r["tf"] for r in own.filter(F.col("tf") >= least_tf).collect()}  # one document's words


def _weighed(hits: DataFrame, n: int, own: dict[str, int], lexicon: Lexicon, least_df: int, size: int) -> list[tuple[str, int, int, float]]:
    """(term, tf, df, weight) of the best of own terms, by one count over the hits of counted()."""
    form = {w: t for t, ws in _forms(lexicon, list(own)).items() for w in ws}
    fold = F.create_map(*[F.lit(x) for kv in form.items() for x in kv])
    df_ = hits.select(F.explode(F.array_distinct(F.transform("_h0", lambda w: F.element_at(fold, w)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = {r["term"]: r["df"] for r in df_.collect()}  # at most one row for each of own
    import math

    rows = [(t, own[t], d, own[t] * math.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in seen.items() if d >= least_df]
    return sorted(rows, key=lambda r: (-round(r[3], 6), r[0]))[:size]


def like_this_terms(df: DataFrame, id_col: str, doc_id, text: Column, lexicon: Lexicon = ZH_FINANCE, size: int = 12, least_tf: int = 1, least_df: int = 1) -> DataFrame:
    """term, tf, df, weight: the document's terms of highest tf * idf."""
    own = _own_terms(df, id_col, doc_id, text, lexicon, least_tf)
    rows = _weighed(counted(df, id_col, {"text": text}, list(own), lexicon), df.count(), own, lexicon, least_df, size) if own else []
    return df.sparkSession.createDataFrame(rows, "term string, tf long, df long, weight double")


def more_like_this(df: DataFrame, id_col: str, doc_id, text: Column, lexicon: Lexicon = ZH_FINANCE, size: int = 10, least_tf: int = 1, least_df: int = 1, terms: int = 12) -> DataFrame:
    """id, score of the documents nearest by the document's best terms, itself left out.  text may join several fields.
    The words are taken once: the occurrences of the document's own terms are kept, narrow, while its best terms are
    chosen from them, and then scored."""
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    own = _own_terms(df, id_col, doc_id, text, lexicon, least_tf)
    rows: list = []
    if own:
        hits = counted(df, id_col, {"text": text}, list(own), lexicon).persist()
        try:
            best = sorted(t for t, _, _, _ in _weighed(hits, hits.count(), own, lexicon, least_df, terms))
            tf = frequencies(hits, 1, best, lexicon)
            top = tf.crossJoin(F.broadcast(statistics(tf, 1, len(best)))).filter(F.col(id_col) != F.lit(doc_id)).select(id_col, bm25_score(0, len(best)).alias("score"))
            rows = top.filter("score > 0").orderBy(F.desc(F.round("score", 6)), id_col).limit(size).collect()  # a report of `size` rows
        finally:
            hits.unpersist()
    return spark.createDataFrame([(r[0], r[1]) for r in rows], f"{id_col} {kind}, score double")


def suggest(df: DataFrame, title: Column, prefix: str, size: int = 5) -> DataFrame:
    return df.select(title.alias("suggestion")).filter(F.lower("suggestion").startswith(prefix.lower())).dropDuplicates().orderBy("suggestion").limit(size)


def trending(search_log: DataFrame, query_col: str = "query", size: int = 10) -> DataFrame:
    return search_log.groupBy(F.lower(F.trim(query_col)).alias("query")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(size)
