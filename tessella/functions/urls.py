"""Columns read from URLs, ids, hashes and times of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the URL patterns, tried in order
DATE_IN_URL = ["(\\d{4})/(\\d{2})/(\\d{2})", "(\\d{4})-(\\d{2})-(\\d{2})", "(\\d{4})(\\d{2})(\\d{2})"]
CODE_IN_URL = ["stock=(\\d{6})", "code=(\\d{6})", "/(\\d{6})/", "(\\d{6})\\."]
ID_IN_URL = ["id=(\\d+)", "/(\\d+)\\.", "/(\\d+)/"]


def first_group(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, else the empty string."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))


def date_in_url(url: Column) -> Column:
    found = [F.when(url.rlike(p), F.concat(F.regexp_extract(url, p, 1), F.lit("-"), F.regexp_extract(url, p, 2), F.lit("-"), F.regexp_extract(url, p, 3), F.lit("T00:00:00"))) for p in DATE_IN_URL]
    return F.coalesce(*found, F.lit(""))


def stock_code_in_url(url: Column) -> Column:
    return first_group(url, CODE_IN_URL)


def announcement_id_in_url(url: Column) -> Column:
    return first_group(url, ID_IN_URL)


def domain(url: Column) -> Column:
    """Host with its port, empty for anything that is not a URL."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def item_id(url: Column, title: Column) -> Column:
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))


def query_param(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def query_map(url: Column) -> Column:
    return F.str_to_map(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))


def build_query(params: Column) -> Column:
    """A map as k=v joined by &, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), "&")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def document_id(given: Column, content_hash: Column, url: Column, title: Column, publish_time: Column) -> Column:
    """The first of: given id, content hash, md5 of the URL, md5 of title and time."""
    return F.coalesce(_filled(given), _filled(content_hash), F.md5(_filled(url)), F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(publish_time.cast("string"), F.lit("")))))


def index_id(content_hash: Column, url: Column, title: Column, publish_time: Column) -> Column:
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(_filled(content_hash), F.md5(F.concat_ws("|", e(url), e(title), e(publish_time))))


def document_hash(title: Column, content: Column, url: Column, publish_time: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (title, content, url, publish_time)]), 256)


def fallback_hash(title: Column, content: Column, url: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.substring(F.coalesce(content, F.lit("")), 1, 500), F.lit("|"), F.coalesce(url, F.lit(""))), 256)


def document_time(publish: Column, crawl: Column, now: Column) -> Column:
    return F.coalesce(publish, crawl, now)


def page_numbers(base: Column, pages: int, template: str = "?page=") -> Column:
    """array of the URLs of pages 1 to n."""
    return F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda i: F.when(i == 1, base).otherwise(F.concat(base, F.lit(template), i.cast("string"))))


def links(html: Column) -> Column:
    """The distinct targets of anchors."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"'#]+)"), F.lit(1)))
