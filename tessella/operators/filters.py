"""Predicates: input validation, URL admission, search filters, payload filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.display import is_spam
from tessella.lexicons import ANNOUNCEMENT_URL_EXCLUDE, ANNOUNCEMENT_URL_INCLUDE, NEWS_URL_EXCLUDE, NEWS_URL_INCLUDE, ZH_FINANCE, Lexicon


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _len(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


def valid_item(strict: bool = False, min_content: int = 50) -> Column:
    ok = (_len("title") > 0) & (_len("content") >= min_content) & (_len("url") > 0)
    return ok & F.col("url").rlike("^https?://") & (_len("title") >= 5) if strict else ok


def valid_news() -> Column:
    return (_len("content") >= 100) & (_len("title") >= 10)


def valid_announcement() -> Column:
    return (_len("content") >= 50) & (_len("title") >= 5)


def _admitted(url: Column, exclude: list[str], include: list[str]) -> Column:
    """Exclusion first; one alternation each, so a URL is scanned twice at most."""
    return (F.coalesce(url, F.lit("")) != "") & ~url.rlike("(?i)" + "|".join(exclude)) & url.rlike("(?i)" + "|".join(include))


def news_url(url: Column) -> Column:
    return _admitted(url, NEWS_URL_EXCLUDE, NEWS_URL_INCLUDE)


def announcement_url(url: Column) -> Column:
    return _admitted(url, ANNOUNCEMENT_URL_EXCLUDE, ANNOUNCEMENT_URL_INCLUDE)


def input_errors(df: DataFrame, sample: int = 10) -> list[str]:
    """Batch validation: the columns exist, rows exist, and the first rows have title and content."""
    missing = [c for c in ("title", "content") if c not in df.columns]
    if missing:
        return [f"missing column: {c}" for c in missing]
    head = df.select("title", "content").limit(sample).collect()
    if not head:
        return ["no documents"]
    return [f"row {i}: {c} is missing" for i, r in enumerate(head) for c in ("title", "content") if not r[c]]


def document_errors(title: Column, content: Column, max_title: int = 500, max_content: int = 50_000) -> Column:
    """array of messages; empty means valid."""
    t, c = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    return F.array_compact(F.array(
        F.when((F.trim(t) == "") & (F.trim(c) == ""), F.lit("title and content are empty")), F.when(F.length(t) > max_title, F.lit("title is too long")), F.when(F.length(c) > max_content, F.lit("content is too long")),
    ))


def embeddable(title: Column, content: Column, least: int = 10) -> Column:
    t, c = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    return ((t != "") | (c != "")) & (F.length(F.concat(t, F.lit(" "), c)) >= least)


def not_stored(df: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    return df.join(stored.select(key).dropDuplicates(), key, "left_anti")


#: Search filters that take a value (equality) or a list (any of).
TERM_FILTERS = {"source": "source", "news_type": "news_type", "industry": "industry", "importance_level": "importance_level", "sentiment": "sentiment_label", "category": "category"}


def preset_start(preset: str, now: datetime) -> datetime | None:
    if preset == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    days = {"week": 7, "month": 30, "year": 365}.get(preset)
    return now - timedelta(days=days) if days else None


def search_filter(spec: dict[str, Any], now: datetime, time_col: str = "publish_time", score_col: str = "quality_score") -> Column:
    """All filters of a search must hold; unknown keys are ignored.  Plain comparisons, so they reach the scan."""
    parts: list[Column] = []
    for key, value in spec.items():
        if key == "date_range":
            start = preset_start(value.get("preset", ""), now) or value.get("start")
            if start:
                parts.append(F.col(time_col) >= F.lit(start).cast("timestamp"))
            if value.get("end"):
                parts.append(F.col(time_col) <= F.lit(value["end"]).cast("timestamp"))
        elif key == "score_range":
            if value.get("min") is not None:
                parts.append(F.col(score_col) >= value["min"])
            if value.get("max") is not None:
                parts.append(F.col(score_col) <= value["max"])
        elif key == "tags":
            parts.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in value])))
        elif key in TERM_FILTERS:
            c = F.col(TERM_FILTERS[key])
            parts.append(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value)
    return conjunction(parts)


def payload_filter(spec: dict[str, Any]) -> Column:
    """Vector payload filter: value, list (any of) or {'range': {'gte', 'lte'}}; other forms are skipped."""
    parts: list[Column] = []
    for key, value in spec.items():
        if isinstance(value, dict):
            bounds = value.get("range", {})
            for name, test in (("gte", lambda c, v: c >= v), ("lte", lambda c, v: c <= v), ("gt", lambda c, v: c > v), ("lt", lambda c, v: c < v)):
                if bounds.get(name) is not None:
                    parts.append(test(F.col(key), bounds[name]))
        elif isinstance(value, (list, tuple)):
            parts.append(F.col(key).isin(list(value)))
        elif isinstance(value, (str, int, float, bool)):
            parts.append(F.col(key) == value)
    return conjunction(parts)


def report_quality(title: Column, content: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    """Not both short, not blank, not spam."""
    short = (F.length(title) < 10) & (F.length(content) < 50)
    return ~short & ((F.trim(title) != "") | (F.trim(content) != "")) & ~is_spam(title, content, lexicon)


def excludes(words: list[str], *fields: Column) -> Column:
    """No field contains any of the words (ignoring case)."""
    return conjunction(~F.lower(F.coalesce(f, F.lit(""))).contains(w.lower()) for w in words for f in fields)


def phrase(text: str, *fields: Column) -> Column:
    """Some field contains the words of the phrase in a row, whatever stands between them."""
    import re

    pattern = "(?iU)(?<![\\p{L}\\p{N}_])" + "[^\\p{L}\\p{N}_]+".join(re.escape(w) for w in re.findall(r"\w+", text)) + "(?![\\p{L}\\p{N}_])"
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit("")).rlike(pattern) for f in fields])


def newer_than(time: Column, threshold: Column) -> Column:
    """Strictly newer; a null time is out."""
    return F.coalesce(time > threshold, F.lit(False))


#: Words that stand for a log level.
LOG_LEVELS = {"ERROR": ["error", "exception", "failed", "fatal"], "WARN": ["warn", "warning"], "INFO": ["info"], "DEBUG": ["debug"]}


def log_filter(text: str | None = None, service: str | None = None, level: str | None = None, line: str = "message") -> Column:
    parts = []
    if service:
        parts.append(F.col("service") == service)
    if level:
        parts.append(F.lower(F.col(line)).rlike("|".join(LOG_LEVELS.get(level.upper(), [level.lower()]))))
    if text:
        parts.append(F.lower(F.col(line)).contains(text.lower()))
    return conjunction(parts)


def report_matches(query: str) -> Column:
    q = query.lower()
    return F.lower(F.coalesce("topic", F.lit(""))).contains(q) | F.lower(F.coalesce("summary", F.lit(""))).contains(q)
