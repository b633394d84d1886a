"""Cleaning as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.lexicons import ZH_FINANCE, Lexicon

#: Patterns of the cleaning steps.
TAG = "<[^>]+>"
URL = "https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\\\(\\\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"
#: The edge of an ASCII word, as \b means in SQL; Java's own \b counts other letters as parts of words too.
EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
MIN_PARAGRAPH = 10
HASH_CHARS = 500
WORDS_PER_MINUTE = 200


def unescape(text: Column) -> Column:
    """The common HTML entities, &amp; last; `unescape_all` covers the whole table."""
    for name, letter in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def unescape_all(text: Column) -> Column:
    """All HTML5 and numeric entities, by an Arrow-batched function."""
    import html


    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)

    return run(text)


def clean_text(text: Column, lexicon: Lexicon = ZH_FINANCE, all_entities: bool = False, space: str = "\\s+", decoded: bool = False) -> Column:
    """Unescape (unless decoded), strip tags, collapse white space, drop URLs and e-mail addresses, replace terms in
    order, trim."""
    text = F.coalesce(text, F.lit(""))
    if not decoded:
        text = unescape_all(text) if all_entities else unescape(text)
    for pattern, put in ((TAG, ""), (space, " "), (URL, ""), (EMAIL.replace("\\b", EDGE), "")):
        text = F.regexp_replace(text, pattern, put)
    for old, new in lexicon.replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(text)


def strip_elements(html: Column) -> Column:
    """Without script, style, meta and link elements."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</\\1\\s*>", "")
    return F.regexp_replace(html, "(?is)<(meta|link)[^>]*>", "")


def clean_content(html: Column, lexicon: Lexicon = ZH_FINANCE, keep_lines: bool = True, min_paragraph: int = MIN_PARAGRAPH, all_entities: bool = False) -> Column:
    """Text of an HTML fragment with its short paragraphs dropped.  keep_lines cleans each line as a paragraph; without
    it the whole text is one paragraph, as white space is collapsed first."""
    body = strip_elements(html)
    if all_entities:
        body = unescape_all(body)
    if not keep_lines:
        whole = clean_text(body, lexicon, decoded=all_entities)
        return F.when(F.length(whole) > min_paragraph, whole).otherwise("")
    lines = F.transform(F.split(body, "\n"), lambda x: clean_text(x, lexicon, decoded=all_entities))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > min_paragraph), "\n")


def normalize_url(url: Column) -> Column:
    return F.substring_index(F.trim(F.coalesce(url, F.lit(""))), "#", 1)


def parse_timestamp(text: Column) -> Column:
    """Several written forms of a time; null where none fits."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]
    millis = F.when(text.rlike("^[0-9]{13}$"), F.timestamp_millis(F.try_to_number(text, F.lit("9" * 13)).cast("long")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], millis)


def content_hash(title: Column, content: Column) -> Column:
    return F.md5(F.concat(title, F.lit("|"), F.substring(content, 1, HASH_CHARS)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def text_stats(content: Column) -> dict[str, Column]:
    n = F.size(words(content))
    filled = F.length(content) > 0
    return {
        "char_count": F.length(content),
        "word_count": F.when(filled, n).otherwise(0),
        "reading_time": F.when(filled, F.greatest(F.lit(1), F.floor(n / WORDS_PER_MINUTE).cast("int"))).otherwise(0),
    }


def clean_documents(df: DataFrame, lexicon: Lexicon = ZH_FINANCE, keep_lines: bool = True, all_entities: bool = True) -> DataFrame:
    """Cleaned title, summary, content, url and times, with hash and counts; other columns stay.  Every HTML entity is
    decoded; all_entities=False knows the six common ones and stays in the JVM."""
    have = set(df.columns)
    out = df.withColumns(
        {c: clean_text(F.col(c), lexicon, all_entities) for c in ("title", "summary") if c in have}
        | {"content": clean_content(F.col("content"), lexicon, keep_lines, all_entities=all_entities)}
        | ({"url": normalize_url(F.col("url"))} if "url" in have else {})
        | {c: parse_timestamp(F.col(c)) for c, t in df.dtypes if c in ("publish_time", "crawl_time") and t == "string"}
    )
    title = F.col("title") if "title" in have else F.lit("")
    return out.withColumns({"content_hash": content_hash(title, F.col("content"))} | text_stats(F.col("content")))


def clean_item_text(text: Column) -> Column:
    """Light cleaning of crawled fields: white space, two entities, control characters."""
    text = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "\\s+", " ")
    text = F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""))


def parse_item_date(text: Column, now: Column) -> Column:
    """Written and relative Chinese dates to a timestamp; `now` is an argument so that results repeat."""
    year = F.date_format(now, "yyyy")
    text = F.regexp_replace(F.trim(text), "(\\d{4})年(\\d{1,2})月(\\d{1,2})日", "$1-$2-$3")
    text = F.when(text.rlike("^\\d{1,2}月\\d{1,2}日"), F.concat(year, F.lit("-"), F.regexp_replace(text, "(\\d{1,2})月(\\d{1,2})日", "$1-$2"))).otherwise(text)
    text = F.replace(text, F.lit("今天"), F.date_format(now, "yyyy-MM-dd"))
    text = F.replace(text, F.lit("昨天"), F.date_format(F.date_sub(now, 1), "yyyy-MM-dd"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-M-d HH:mm:ss", "yyyy-M-d HH:mm", "yyyy-M-d")], parse_timestamp(text))


def item_tags(text: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), "[,;，；\\s]+")
    return F.slice(F.filter(parts, lambda x: F.length(x).between(2, 20)), 1, 10)


def item_code(text: Column) -> Column:
    return F.upper(F.trim(text))


def take_first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), 0)


def search_text(text: Column, punctuation: str = ".,!?;:") -> Column:
    """White space collapsed; only Han, letters, digits and the given punctuation stay."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")
    keep = "".join("\\" + c for c in punctuation)
    return F.trim(F.regexp_replace(text, f"[^一-龥0-9A-Za-z\\s{keep}]", ""))


def embedding_text(text: Column, limit: int = 512) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), 1, limit)
