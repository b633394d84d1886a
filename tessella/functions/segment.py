"""Tokens and keywords of a text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import fields
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.lexicons import ZH_FINANCE, Lexicon

_HAN = "[一-龥]"
_LATIN = "[\\p{L}\\p{N}_&&[^一-龥]]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased letter and digit runs; each Han character is a token of its own.  Those of `least` characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{_HAN}|{_LATIN}" if least < 2 else f"{_LATIN[:-1]}{{{least},}}"), F.lit(0))


def _pairs(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))


def bigrams(text: Column) -> Column:
    """Han runs as overlapping pairs (single characters stay single), other tokens as they are."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{_HAN}+|{_LATIN}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^{_HAN}{{2,}}$"), _pairs(run)).otherwise(F.array(run))))


def _strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(k)
            yield from _strings(v)
    elif isinstance(value, list | tuple):
        for v in value:
            yield from _strings(v)


def dictionary(lexicon: Lexicon = ZH_FINANCE) -> tuple[str, ...]:
    """The Han words of two or more characters that the lexicon names anywhere, longer ones first."""
    return _dictionary(lexicon.name, tuple(sorted({w for f in fields(lexicon) for s in _strings(getattr(lexicon, f.name)) for w in re.split("[,|]", s) if re.fullmatch(f"{_HAN}{{2,}}", w)}, key=lambda w: (-len(w), w))))


@lru_cache(maxsize=8)
def _dictionary(name: str, words: tuple[str, ...]) -> tuple[str, ...]:
    return words


def _known(lexicon: Lexicon) -> str:
    return "|".join(dictionary(lexicon))


def words(text: Column, lexicon: Lexicon = ZH_FINANCE, index: bool = False) -> Column:
    """Lower-cased words.  Latin letter and digit runs are words; in Han text the longest words of the lexicon are taken
    from the left and what lies between them becomes overlapping pairs, so no word is lost for want of an entry.  For
    an index, known words of three or more characters give their pairs too, so a shorter query finds them."""
    known = _known(lexicon)
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(f"{known}|(?:(?!{known}){_HAN})+|{_LATIN}" if known else f"{_HAN}+|{_LATIN}"), F.lit(0))

    def split(run: Column) -> Column:
        whole = run.isin(list(dictionary(lexicon))) if known else F.lit(False)
        out = F.when(whole, F.concat(F.array(run), _pairs(run)) if index else F.array(run)).otherwise(_pairs(run))
        return F.when(run.rlike(f"^{_HAN}{{3,}}$"), out).otherwise(F.array(run))

    return F.when(low.rlike(_HAN), F.flatten(F.transform(runs, split))).otherwise(tokens(text))


def words_of(text: str, lexicon: Lexicon = ZH_FINANCE) -> list[str]:
    """words() of a string, on the driver."""
    known = _known(lexicon)
    han = f"{known}|(?:(?!{known}){_HAN})+" if known else f"{_HAN}+"
    out = []
    for run in re.findall(f"{han}|[^\\W一-龥]+", text.lower()):
        whole = len(run) < 3 or not re.fullmatch(f"{_HAN}+", run) or run in dictionary(lexicon)
        out += [run] if whole else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def longest_match(text: Column, terms: list[str]) -> Column:
    """Forward maximum match over a dictionary: Latin runs whole, Han by the longest known term, else one character.
    The dictionary is an alternation with longer terms first, so this stays a column expression."""
    known = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    head = f"{known}|" if known else ""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{head}{_HAN}|{_LATIN}"), F.lit(0))


def segment(text: Column, stopwords: list[str] = (), segmenter: Callable[[Column], Column] = words) -> Column:
    """Words without stopwords and without digit strings of more than ten characters."""
    out = F.filter(segmenter(text), lambda x: ~x.rlike("^[0-9]{11,}$"))
    return F.filter(out, lambda x: ~x.isin(list(stopwords))) if stopwords else out


def tagged(text: Column, segmenter: Callable[[Column], Column] = words, tagger: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<word, pos>>; without a tagger every word is tagged n."""
    return F.transform(segmenter(text), lambda w: F.struct(w.alias("word"), (tagger(w) if tagger else F.lit("n")).alias("pos")))


def keyword_weights(terms: DataFrame, id_col: str, k: int = 20) -> DataFrame:
    """id, term, weight: frequency over the document's highest frequency, top k.  terms: id, term, pos."""
    counts = terms.groupBy(id_col, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    by = Window.partitionBy(id_col)
    ranked = counts.withColumn("weight", F.col("n") / F.max("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "first")))
    return ranked.filter(F.col("rank") <= k).select(id_col, "term", "weight", "rank")


def tfidf_keywords(terms: DataFrame, id_col: str, n_docs: int, k: int = 20) -> DataFrame:
    """id, term, tfidf, rank: tf / length * ln(n_docs / df), top k; ties by term."""
    tf = terms.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = terms.groupBy(id_col).agg(F.count("*").alias("len"))
    scored = tf.join(df, "term").join(size, id_col).withColumn("tfidf", F.col("tf") / F.col("len") * F.log(F.lit(n_docs) / F.col("df")))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.round("tfidf", 9)), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "term", "tfidf", "rank")


def query_terms(query: str, lexicon: Lexicon = ZH_FINANCE) -> list[str]:
    """Keywords of a query string, on the driver."""
    stop = set(lexicon.query_stopwords)
    return [w for w in re.sub(r"[^\w\s]", " ", query).split() if len(w) > 1 and w not in stop]
