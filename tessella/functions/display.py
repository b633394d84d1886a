"""Scores of keywords, highlights, snippets, formats: small scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.features import any_word, count_words
from tessella.lexicons import SUGGESTION_ENDINGS, SUGGESTIONS, ZH_FINANCE, Lexicon


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a non-empty word."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def keyword_score(title: Column, content: Column, keywords: list[str]) -> Column:
    """Sum of 2 x hits in the title and hits in the content over 3 x keywords, at most 1."""
    if not keywords:
        return F.lit(0.0)
    t, c = F.lower(title), F.lower(content)
    total = sum((occurrences(t, k.lower()) * 2 + occurrences(c, k.lower()) for k in keywords), F.lit(0.0))
    return F.least(total / (3.0 * len(keywords)), F.lit(1.0))


def bold(text: Column, keywords: list[str]) -> Column:
    """**word** around each occurrence, ignoring case, written as in the query."""
    for k in keywords:
        text = F.regexp_replace(text, "(?i)" + re.escape(k), "**" + k.replace("\\", "\\\\").replace("$", "\\$") + "**")
    return text


def mark(text: Column, keywords: list[str], open_: str = "<mark>", close: str = "</mark>") -> Column:
    """Marks around each occurrence, ignoring case, written as in the text."""
    if not keywords:
        return text
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(k) for k in sorted(keywords, key=len, reverse=True)) + ")", f"{open_}$1{close}")


def fragments(text: Column, keywords: list[str], size: int = 150, count: int = 3) -> Column:
    """Up to `count` marked pieces of `size` characters that contain a keyword, in text order: the text is cut at
    fixed places, so a fragment never depends on another."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    hit = F.filter(cuts, lambda x: any_word(F.lower(x), [k.lower() for k in keywords]))
    return F.transform(F.slice(hit, 1, count), lambda x: mark(x, keywords))


def snippet(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def budget_summary(text: Column, limit: int = 200, ends: str = "[。！？.!?]") -> Column:
    """Whole sentences from the start while they fit; a first sentence that does not fit is cut."""
    sentences = F.filter(F.transform(F.split(text, ends), lambda s: F.trim(s)), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & (F.length(acc["out"]) + F.length(s) + 1 <= limit)
        return F.struct((acc["full"] | ~fits).alias("full"), F.when(fits, F.concat(acc["out"], s, F.lit("。"))).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(sentences, F.struct(F.lit(False).alias("full"), F.lit("").alias("out")), step, lambda a: a["out"])
    return F.when(out != "", out).otherwise(snippet(text, limit))


def large_number(n: Column) -> Column:
    return F.when(n >= 1e8, F.concat(F.format_number(n / 1e8, 1), F.lit("亿"))).when(n >= 1e4, F.concat(F.format_number(n / 1e4, 1), F.lit("万"))).when(n >= 1e3, F.concat(F.format_number(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def percentage(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def relative_time(t: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(t)) / 60)
    return (
        F.when(minutes < 1, "刚刚").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("分钟前")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("小时前"))).when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("天前")))
        .otherwise(F.date_format(t, "yyyy-MM-dd"))
    )


def simple_sentiment(text: Column, lexicon: Lexicon = ZH_FINANCE, short: bool = False) -> Column:
    """(p - n) / (p + n) over words present; short drops the last two words of each list."""
    p = count_words(text, lexicon.report_positive[:-2] if short else lexicon.report_positive)
    n = count_words(text, lexicon.report_negative[:-2] if short else lexicon.report_negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(F.lit(0.0))


def report_importance(text: Column, title: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    """3 / 1.5 a high word and 2 / 1 a medium word in the title / only in the text, scaled by length, at most 1."""
    low, head = F.lower(text), F.lower(title)
    score = F.lit(0.0)
    for words, a, b in ((lexicon.report_high, 3.0, 1.5), (lexicon.report_medium, 2.0, 1.0)):
        for w in words:
            score = score + F.when(head.contains(w.lower()), a).when(low.contains(w.lower()), b).otherwise(0.0)
    score = F.when(F.length(text) > 1000, score * 1.2).when(F.length(text) < 200, score * 0.8).otherwise(score)
    return F.least(F.lit(1.0), score / 10.0)


def is_spam(title: Column, content: Column, lexicon: Lexicon = ZH_FINANCE, least: int = 3) -> Column:
    return count_words(F.lower(F.concat(title, F.lit(" "), content)), lexicon.report_spam) >= least


def relevance(title: Column, content: Column, topic: str, keywords: list[str], original: Column, published: Column, now: Column) -> Column:
    """3 for the topic, 1.5 a keyword occurrence, 2 a keyword in the title, half the original score, half a freshness
    that falls to 0 over 30 days."""
    t = F.lower(title)
    text = F.concat(t, F.lit(" "), F.lower(content))
    score = F.when(text.contains(topic.lower()), 3.0).otherwise(0.0)
    for k in keywords:
        score = score + occurrences(text, k.lower()) * 1.5 + F.when(t.contains(k.lower()), 2.0).otherwise(0.0)
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400)
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1.0 - days / 30.0), F.lit(0.0))
    return score + F.coalesce(original, F.lit(0.0)) * 0.5 + fresh * 0.5


def decode_json(value: Column) -> Column:
    """A variant from strings that look like JSON, null from others."""
    return F.when(value.rlike("^\\s*[{\\[]"), F.try_parse_json(value))


def normalized_score(score: Column) -> Column:
    return F.least(F.coalesce(score, F.lit(0.0)) / 10.0, F.lit(1.0))


def static_suggestions(partial: str, limit: int = 5) -> list[str]:
    return [s for s in SUGGESTIONS if partial.lower() in s.lower()][:limit]


def template_suggestions(query: str, limit: int = 5) -> list[str]:
    return [query + e for e in SUGGESTION_ENDINGS][:limit]
