"""Canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _split(text: str) -> list[str]:
    """text at its commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def _type(text: str) -> T.DataType:
    name, _, inner = text.partition("<")
    inner = inner.rstrip()[:-1] if inner else ""
    if name == "array":
        return T.ArrayType(_type(inner))
    if name == "map":
        return T.MapType(*map(_type, _split(inner)))
    if name == "struct":
        return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(":", 1) for f in _split(inner))])
    if name.startswith("decimal("):
        return T.DecimalType(*map(int, name[8:-1].split(",")))
    return _SIMPLE[name]


def ddl(text: str) -> T.StructType:
    """A schema from "name type, ..." without a running session."""
    return T.StructType([T.StructField(n, _type(t)) for n, t in (f.split(" ", 1) for f in _split(text))])


ENTITY = "struct<text:string,type:string,confidence:double>"
RAW_DDL = (
    "id string, type string, title string, content string, url string, source string, author string, category string, tags array<string>, "
    "publish_time timestamp, crawl_time timestamp, content_length int, metadata map<string,string>"
)
RAW_DOCUMENTS = ddl(RAW_DDL)
ANNOUNCEMENTS = ddl(RAW_DDL + ", exchange string, company_name string, stock_code string, announcement_type string, announcement_id string, is_important boolean")
RESEARCH_REPORTS = ddl(
    "id string, title string, abstract string, content string, research_institution string, analysts array<string>, report_type string, target_stocks array<string>, "
    "target_industry string, investment_rating string, target_price decimal(18,4), published_at timestamp, report_period string, pdf_url string, file_size long, page_count int, "
    "source string, url string, metadata map<string,string>"
)
MARKET_DATA = ddl(
    "symbol string, name string, exchange string, open decimal(18,4), high decimal(18,4), low decimal(18,4), close decimal(18,4), current decimal(18,4), volume long, "
    "turnover decimal(20,4), market_cap decimal(24,4), price_change decimal(18,4), price_change_percent double, trading_date date, ts timestamp, source string, url string"
)
PROCESSED = ddl(
    RAW_DDL + ", content_hash string, char_count int, word_count int, reading_time int, keywords array<string>, "
    f"entities array<{ENTITY}>, auto_summary string, categories array<string>, sentiment struct<label:string,score:double,confidence:double>, importance_score double, "
    "quality struct<overall:double,completeness:double,content_quality:double,information_value:double,spam:double,structure:double,is_spam:boolean,is_high_quality:boolean,issues:array<string>>, quality_label string"
)
ENTITY_OFFSETS = ddl("doc_id string, text string, type string, start int, end int, confidence double, source string")
POSTINGS = ddl("doc_id long, field string, term string, tf int, pos array<int>")
SNAPSHOT = ddl("doc_id string, hash string, ts timestamp, url string, title string, source string")
CHANGES = ddl("doc_id string, change string, current struct<hash:string,ts:timestamp,url:string,title:string,source:string>, previous struct<hash:string,ts:timestamp,url:string,title:string,source:string>")
TREND = ddl("date date, volume long, sentiment double, importance double, value double, anomaly boolean, anomaly_score double, anomaly_reason string")
LOG_LINES = ddl("timestamp timestamp, service string, level string, message string")
CHANGE_LOG = ddl("timestamp timestamp, created long, updated long, deleted long, unchanged long, total_changes long")

#: Value of a missing or null field at the entry of a stage.
DEFAULTS = {"title": "", "content": "", "url": "", "source": "", "summary": ""}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema, cast; a column that df lacks becomes a typed null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(DEFAULTS.get(name, "")))
