"""Keywords, entities, summary, categories, sentiment and importance of a document."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.segment import words, words_of
from tessella.lexicons import ZH_FINANCE, Lexicon

_HAN, _LATIN = re.compile("[一-龥]"), re.compile("[^\\W一-龥]{2,}")


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]) if words else F.lit(False)


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text at least once."""
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words]) if words else F.lit(0)


def doc_terms(df: DataFrame, id_col: str, text: Column, lexicon: Lexicon = ZH_FINANCE, segmenter=None) -> DataFrame:
    """id, term, pos: the terms that may be keywords, by default the words by the lexicon."""
    terms = df.select(F.col(id_col), F.posexplode(segmenter(text) if segmenter else words(text, lexicon)).alias("pos", "term"))
    return terms.filter((F.length("term") > 1) & ~F.col("term").isin(lexicon.keyword_stopwords))


def top_keywords(df: DataFrame, id_col: str, text: Column, k: int = 10, lexicon: Lexicon = ZH_FINANCE, segmenter=None) -> DataFrame:
    """id, term, freq, rank: the k commonest terms of each document, ties by first occurrence.  Two-level: terms are
    counted map-side before the shuffle, and only ranks up to k survive the window."""
    counts = doc_terms(df, id_col, text, lexicon, segmenter).groupBy(id_col, "term").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("freq"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "term", "freq", "rank")


def keywords_array(text: Column, k: int = 10, lexicon: Lexicon = ZH_FINANCE, segmenter=None) -> Column:
    """The same terms as an array, inside one row, without a shuffle.  Words by the lexicon are counted by an Arrow-batched
    function, since a fold copies all it has for each different word; those of a segmenter are sorted and their runs counted."""
    if segmenter is None:
        stop = frozenset(lexicon.keyword_stopwords)

        @F.pandas_udf("array<string>")
        def commonest(s: pd.Series) -> pd.Series:
            found = (words_of(v, lexicon) if _HAN.search(v) else _LATIN.findall(v.lower()) for v in s.fillna(""))
            return pd.Series([[w for w, _ in Counter(w for w in ws if len(w) > 1 and w not in stop).most_common(k)] for ws in found])  # of equal counts, what came first

        return commonest(text)
    t = F.filter(segmenter(text), lambda x: (F.length(x) > 1) & ~x.isin(lexicon.keyword_stopwords))
    ordered = F.array_sort(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<struct<n:int,i:int,w:string>>").alias("out"))
    run = lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(F.struct((-acc["n"]).alias("n"), acc["i"].alias("i"), acc["w"].alias("w"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        same = acc["w"] == x["w"]
        return F.struct(x["w"].alias("w"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"), F.when(same, acc["i"]).otherwise(x["i"]).alias("i"), F.when(same, acc["out"]).otherwise(run(acc)).alias("out"))

    counted = F.aggregate(ordered, start, step, run)
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda x: x["w"])


def entities(text: Column, lexicon: Lexicon = ZH_FINANCE, confidence: float = 0.8) -> Column:
    """array<struct<text, type, confidence>> by type, then position; overlaps stay."""
    each = [
        F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _entity(kind, confidence))
        for kind, p in lexicon.entity_patterns.items()
    ]
    return F.concat(*each)


def _entity(kind: str, confidence: float):
    return lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def summary(content: Column, title: Column, lexicon: Lexicon = ZH_FINANCE, sentences: int = 3, limit: int = 200) -> Column:
    parts = F.filter(F.transform(F.split(content, lexicon.sentence_end), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    text = F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, 1, sentences), lexicon.sentence_join), F.lit(lexicon.sentence_join))).otherwise(title)
    text = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.when(F.length(content) > 0, text).otherwise(title)


def categories(text: Column, lexicon: Lexicon = ZH_FINANCE, fold_case: bool = True) -> Column:
    """The categories any of whose words occurs, in dictionary order, else the default.  fold_case=False keeps the
    mixed comparison in which upper-case words never match lower-cased text."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(any_word(low, [w.lower() if fold_case else w for w in words]), F.lit(c)) for c, words in lexicon.categories.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(lexicon.category_default)))


def sentiment(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    """struct<label, score, confidence> from the distinct lexicon words present."""
    p, n = count_words(text, lexicon.positive_short), count_words(text, lexicon.negative_short)
    score = F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))
    label = F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral")
    confidence = F.when(F.length(text) == 0, F.lit(0.0)).when(p + n == 0, F.lit(0.5)).otherwise(F.least(F.lit(0.9), F.abs(score) + 0.3))
    return F.struct(label.alias("label"), score.alias("score"), confidence.alias("confidence"))


def importance(word_count: Column, n_entities: Column, cats: Column, sentiment_confidence: Column, n_keywords: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    score = (
        F.when(word_count > 100, 0.2).otherwise(0.0) + F.when(word_count > 500, 0.2).otherwise(0.0) + F.least(F.lit(0.3), n_entities * 0.05)
        + F.when(F.arrays_overlap(cats, F.array(*[F.lit(c) for c in lexicon.important_categories])), 0.2).otherwise(0.0)
        + F.when(sentiment_confidence > 0.7, 0.1).otherwise(0.0) + F.least(F.lit(0.2), n_keywords * 0.02)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def extract_features(df: DataFrame, lexicon: Lexicon = ZH_FINANCE, k: int = 10) -> DataFrame:
    """df with keywords, entities, auto_summary, categories, sentiment and importance_score; documents without title
    and content keep empty features."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    text = F.concat(title, F.lit(" "), content)
    out = df.withColumns({
        "keywords": keywords_array(text, k, lexicon), "entities": entities(text, lexicon), "auto_summary": summary(content, title, lexicon),
        "categories": categories(text, lexicon), "sentiment": sentiment(text, lexicon),
    })
    return out.withColumn("importance_score", importance(F.col("word_count"), F.size("entities"), F.col("categories"), F.col("sentiment.confidence"), F.size("keywords"), lexicon))
