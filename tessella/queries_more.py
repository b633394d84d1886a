"""Queries of the write path, the incremental layer, streams and the smaller functions, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import clean, display, segment, sentiment, urls
from tessella.lexicons import ZH_FINANCE as ZH
from tessella.operators import aggregates, dedup, filters, fulltext, graph, tables, vectors
from tessella.plans import report, search
from tessella.queries import L, NOW, WITH, _analyzed, _bm25_sql, _count, _q, _r, _rules_sql, query, r
from tessella.schemas import ddl
from tessella.session import articles, load, scratch
from tessella.sources import store
from tessella.streaming import incremental

ROWS = ddl("c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


def _path(spark: SparkSession, name: str) -> str:
    """A folder of this run's own in the shared scratch space; it goes when the JVM ends."""
    path = f"{scratch(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _customers(spark, d):
    return load(spark, d, "customer").select(*ROWS.names)


def _table(spark, name: str = "table") -> store.Table:
    return store.Table(spark, _path(spark, name), ROWS, "c_custkey")


# stored tables ------------------------------------------------------------------------------------------------------

_CHANGED = """b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
    u AS (SELECT coalesce(b.c_custkey, p.k) AS c_custkey, c_name, c_acctbal, CASE WHEN p.k IS NOT NULL THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM b FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0) p ON p.k = b.c_custkey)"""


def _changed(spark, d) -> store.Table:
    c, t = _customers(spark, d), _table(spark)
    t.append(c.filter("c_custkey % 2 = 0 and c_custkey % 4 = 0"))
    t.append(c.filter("c_custkey % 2 = 0 and c_custkey % 4 <> 0"), batch="second")
    t.append(c.filter("c_custkey % 2 = 0 and c_custkey % 4 <> 0"), batch="second")  # a repeated batch adds nothing
    t.upsert(c.filter("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))))
    t.update(c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")))
    return t


@query(f"WITH {_CHANGED} SELECT * FROM u WHERE c_custkey % 7 <> 0 AND NOT coalesce(c_acctbal < 0, false)")
def table_changes(spark, d):
    t = _changed(spark, d)
    t.delete(_customers(spark, d).filter("c_custkey % 7 = 0"))
    t.delete_where(F.col("c_acctbal") < 0)
    return t.read()


@query(f"WITH {_CHANGED} SELECT * FROM u WHERE c_mktsegment = 'PATCHED' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def table_page(spark, d):
    return _changed(spark, d).list(F.col("c_mktsegment") == "PATCHED", 20, 10)


@query(f"WITH {_CHANGED} SELECT coalesce(c_mktsegment, '-') AS segment, count(*) AS n FROM u GROUP BY ALL")
def table_backup(spark, d):
    t, to = _changed(spark, d), _path(spark, "backup")
    t.backup(to)
    t.truncate()
    t.restore(to)
    t.compact()
    t.vacuum(1)
    return t.read().groupBy(F.coalesce("c_mktsegment", F.lit("-")).alias("segment")).agg(F.count("*").alias("n"))


@query(f"WITH {_CHANGED} SELECT 'low' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM u WHERE c_acctbal < 100 UNION ALL SELECT 'all', count(*), CAST(sum(c_custkey) AS BIGINT) FROM (SELECT c_custkey FROM u UNION ALL SELECT c_custkey FROM customer)")
def table_views(spark, d):
    t, whole = _changed(spark, d), _table(spark, "whole")
    whole.append(_customers(spark, d))
    names = [f"v_{uuid.uuid4().hex}" for _ in range(2)]
    t.view(names[0], F.col("c_acctbal") < 100)
    store.union_view(names[1], t, whole)
    one = lambda n, part: spark.table(n).agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
    return one(names[0], "low").unionByName(one(names[1], "all"))


@query("SELECT 'upserts' AS what, count(*) AS n, count(DISTINCT c_name) AS names FROM customer")
def table_upserts(spark, d):
    """Twelve upserts of overlapping slices: parts are merged on reading and rewritten once in a while."""
    c, t = _customers(spark, d), _table(spark)
    for i in range(12):
        t.upsert(c.filter(F.pmod("c_custkey", F.lit(12)).isin(i, (i + 1) % 12)), batch=str(i))
    return t.read().agg(F.lit("upserts").alias("what"), F.count("*").alias("n"), F.count_distinct("c_name").alias("names"))


@query(f"{WITH} SELECT CASE category WHEN 'en' THEN 'news' WHEN 'de' THEN 'announcement' ELSE 'general' END AS index_name, count(*) AS n FROM articles GROUP BY ALL")
def routed_documents(spark, d):
    a, to = articles(spark, d).withColumn("category", F.when(F.col("category") == "en", "news").when(F.col("category") == "de", "announcement").otherwise("x")), _path(spark, "routed")
    store.write_routed(a.select("doc_id", "category"), to)
    return spark.read.parquet(to).groupBy("index_name").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT doc_id AS id, title, substring(content, 1, 200) AS summary, source, url, 0 AS view_count FROM articles WHERE coalesce(title, '') <> '' AND coalesce(content, '') <> ''")
def gateway_documents(spark, d):
    a = articles(spark, d).withColumn("id", F.col("doc_id")).withColumn("tags", F.array().cast("array<string>"))
    return store.gateway_documents(a).select("id", "title", "summary", "source", "url", "view_count")


@query(f"{WITH}, w AS (SELECT doc_id, CAST(floor(length(content) / 5) AS INTEGER) AS word_count FROM articles) SELECT doc_id, word_count, greatest(1, CAST(round(word_count / 250) AS INTEGER)) AS reading_time FROM w")
def ingest_fields(spark, d):
    return store.ingest_fields(articles(spark, d).withColumn("content_raw", F.lit("x")), F.lit(NOW)).select("doc_id", "word_count", "reading_time")


@query("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def not_stored(spark, d):
    docs = load(spark, d, "documents").withColumn("content_hash", F.md5("text"))
    return filters.not_stored(docs, docs.filter("doc_id % 3 = 0")).select("doc_id")


# changes ------------------------------------------------------------------------------------------------------------

_DOCS = "n AS (SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 0)"


def _before_after(spark, d):
    a = articles(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    return a.filter("doc_id % 3 <> 0"), a.filter("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))


def _change_sql(old: str = "doc_id % 3 <> 0", new: str = "doc_id % 7 <> 0") -> str:
    return f"CASE WHEN NOT ({old}) THEN 'created' WHEN NOT ({new}) THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_change_sql()} AS change FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 7 <> 0")
def detected_changes(spark, d):
    """A full run against the snapshot that an earlier run committed."""
    old, new = _before_after(spark, d)
    det, now = incremental.ChangeDetector(spark, _path(spark, "changes")), F.lit(NOW)
    det.commit(old, det.detect(old, now), now)
    return det.detect(new, now).select("doc_id", "change")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_change_sql()} AS change FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 30 > 19 AND {_change_sql()} IN ('created', 'updated')")
def incremental_changes(spark, d):
    """An increment: only documents newer than the mark, no deletions."""
    from datetime import datetime

    old, new = _before_after(spark, d)
    det, now = incremental.ChangeDetector(spark, _path(spark, "changes")), F.lit(NOW)
    det.commit(old, det.detect(old, now), now)
    return det.detect(new, now, full=False, since=datetime(2024, 1, 20)).select("doc_id", "change")


@query("SELECT count(*) FILTER (WHERE run = 1) AS n_created, count(*) FILTER (WHERE run = 2 AND c = 'updated') AS n_updated, count(*) FILTER (WHERE run = 2 AND c = 'deleted') AS n_deleted, 2 AS runs FROM (SELECT 1 AS run, 'created' AS c FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 1, 'created' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 2, "
       + _change_sql() + " FROM documents WHERE doc_id % 3 <> 0)")
def change_log(spark, d):
    old, new = _before_after(spark, d)
    det, now = incremental.ChangeDetector(spark, _path(spark, "changes")), F.lit(NOW)
    det.commit(old, det.detect(old, now), now)
    det.commit(new, det.detect(new, now), F.timestamp_add("HOUR", F.lit(1), now))
    t = det.totals()
    return t.select(F.col("created").alias("n_created"), F.col("updated").alias("n_updated"), F.col("deleted").alias("n_deleted"), F.col("runs").cast("int").alias("runs"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(content) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM (" + f"{WITH} SELECT * FROM articles" + ") WHERE doc_id % 7 <> 0")
def applied_changes(spark, d):
    """The target table after the changes of two runs."""
    old, new = _before_after(spark, d)
    det, now = incremental.ChangeDetector(spark, _path(spark, "changes")), F.lit(NOW)
    target = store.Table(spark, _path(spark, "target"), ddl("id string, title string, content string"), "id")
    for docs in (old, new):
        changes = det.detect(docs, now)
        incremental.apply_changes(docs, changes, target)
        det.commit(docs, changes, now)
    return target.read().select("id", F.length("content").alias("size"))


_SIDES = "o AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderdate AS t, 0 AS side FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v, o_orderdate + to_days(CAST(o_orderkey % 5 - 2 AS INTEGER)) AS t, 1 AS side FROM orders WHERE o_orderkey % 3 = 0)"


def _sides(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("t"))
    return o.filter("k % 2 = 0"), o.filter("k % 3 = 0").select("k", (F.col("v") + 1).alias("v"), F.timestamp_add("DAY", (F.col("k") % 5 - 2).cast("int"), F.col("t")).alias("t"))


@query(f"WITH {_SIDES}, u AS (SELECT * FROM o UNION ALL SELECT * FROM n), w AS (SELECT k, arg_max(v, (t, side)) AS v FROM u GROUP BY k) SELECT k, floor(v * 100 + 0.5) / 100 AS v FROM w")
def conflicts_latest_wins(spark, d):
    return tables.resolve_conflicts(*_sides(spark, d), "k", "t").select("k", r(F.col("v"), 2).alias("v"))


@query(f"WITH {_SIDES} SELECT k, floor(v * 100 + 0.5) / 100 AS v FROM o UNION ALL SELECT k, floor(v * 100 + 0.5) / 100 FROM n WHERE k NOT IN (SELECT k FROM o)")
def conflicts_skip(spark, d):
    return tables.resolve_conflicts(*_sides(spark, d), "k", "t", "skip").select("k", r(F.col("v"), 2).alias("v"))


@query(f"WITH {_SIDES}, u AS (SELECT * FROM o UNION ALL SELECT * FROM n) SELECT k, floor(v * 100 + 0.5) / 100 AS v, count(*) OVER (PARTITION BY k) > 1 AS conflict FROM u")
def conflicts_manual(spark, d):
    return tables.resolve_conflicts(*_sides(spark, d), "k", "t", "manual").select("k", r(F.col("v"), 2).alias("v"), "conflict")


# duplicates ---------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT doc_id, md5(text) AS h FROM documents), s AS (SELECT DISTINCT h FROM h WHERE doc_id % 11 = 0), m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h) SELECT doc_id, CASE WHEN h IN (SELECT h FROM s) THEN '' WHEN first <> doc_id THEN CAST(first AS VARCHAR) END AS dup_of FROM m")
def dedup_against_state(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return dedup.exact(docs, "h", "doc_id", docs.filter("doc_id % 11 = 0").select("h")).select("doc_id", "dup_of")


@query("""WITH s AS (SELECT 'u' || (event_id % 300) AS url, max(ts) AS marked_at FROM events WHERE event_id % 2 = 0 GROUP BY ALL), l AS (SELECT * FROM s WHERE marked_at > (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
    n AS (SELECT DISTINCT 'u' || (event_id % 100) AS url, (SELECT max(ts) FROM events) AS marked_at FROM events) SELECT url, max(marked_at) AS marked_at FROM (SELECT * FROM l UNION ALL SELECT * FROM n) GROUP BY url""")
def url_state(spark, d):
    """The URL state after a batch: marks of the last seven days and the batch's own."""
    e = load(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    state = e.filter("event_id % 2 = 0").groupBy(F.concat(F.lit("u"), (F.col("event_id") % 300).cast("string")).alias("url")).agg(F.max("ts").alias("marked_at"))
    new = e.select(F.concat(F.lit("u"), (F.col("event_id") % 100).cast("string")).alias("url"))
    return dedup.with_urls(state, new, now).withColumn("marked_at", F.col("marked_at").cast("timestamp_ntz"))


@query("WITH e AS (SELECT event_id, 'u' || (event_id % 700) AS url, event_type || (user_id % 40) AS title FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS rn FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY md5(title) ORDER BY event_id) AS rt FROM a WHERE rn = 1) SELECT event_id, url, title FROM b WHERE rt = 1")
def item_dedup(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("u"), (F.col("event_id") % 700).cast("string")).alias("url"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("title"))
    return dedup.item_dedup(e, "event_id").select("event_id", "url", "title")


@query("WITH h AS (SELECT doc_id, md5(text) AS h, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE first <> doc_id) AS exact, 0::BIGINT AS near, count(*) FILTER (WHERE first = doc_id) AS kept FROM h")
def dedup_counts(spark, d):
    m = dedup.exact(load(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), "h", "doc_id")
    return dedup.dedup_stats(m.withColumn("dup_kind", F.when(F.col("dup_of").isNotNull(), "exact")))


# streams ------------------------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    """events as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, spark, mode: str = "append"):
    """The rows of a stream that has taken all there is."""
    to, seen = _path(spark, "stream"), []
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/mark").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{to}/rows")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{to}/rows-{number}")
        seen.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{to}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/rows-{max(seen)}")


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, {_r('sum(value)', 2)} AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    w = _run(incremental.windowed_counts(_event_stream(spark, d), "ts", ["event_type"], "1 day", value="value"), spark, "complete")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("total"), 2).alias("total"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_dedup(spark, d):
    """One row per user and event type within the time to live, which covers the whole table."""
    s = incremental.dedup_stream(_event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days")
    return _run(s.select("user_id", "event_type"), spark).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upserts(spark, d):
    """The newest event of each user, upserted by a stream that is started twice."""
    t = store.Table(spark, _path(spark, "newest"), ddl("user_id long, event_id long"), "user_id")
    mark = _path(spark, "mark")
    for _ in range(2):
        incremental.start_upserts(_event_stream(spark, d).select("user_id", "event_id"), t, mark, order=[F.desc("event_id")]).awaitTermination()
    return t.read()


@query("SELECT 'ok' AS source, count(*) AS documents, 0 AS errors, 'running' AS state FROM orders UNION ALL SELECT 'bad', 0, 1, 'running'")
def sync_runs(spark, d):
    """Registered sources pulled by the sync manager; one fails without stopping the other."""
    m = incremental.SyncManager(spark)
    m.register("ok", lambda s, since: load(s, d, "orders"), lambda df: None)
    m.register("bad", lambda s, since: load(s, d, "missing"), lambda df: None)
    m.start()
    m.tick(NOW)
    return spark.createDataFrame([(x["source_id"], x["documents"], x["errors"], m.state) for x in m.runs], "source string, documents long, errors int, state string")


# words and small functions ------------------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, len(list_filter({_TOK}, lambda x: NOT regexp_matches(x, '^[0-9]{{11,}}$') AND x NOT IN ('the', 'of'))) AS n_words, len(list_filter({_TOK}, lambda x: true)) AS n_tagged FROM documents")
def segmented(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.size(segment.segment(t, ["the", "of"], lambda c: segment.words(c, L))).alias("n_words"), F.size(F.filter(segment.tagged(t, lambda c: segment.words(c, L)), lambda w: w["pos"] == "n")).alias("n_tagged"))


_ZH_ROWS = [
    (1, "央行宣布降准，新能源汽车板块上涨，机构看好后市。"), (2, "某公司公告净利润亏损，股价跌停，投资风险较大。"), (3, "比亚迪销量大幅增长，业绩超预期，分析师推荐买入。"), (4, "证监会发布监管政策，要求信息披露。"), (5, "plain latin text"), (6, ""),
    (7, "国际原油价格下跌，全球市场担忧经济衰退。"), (8, "银行板块走低，成交萎缩，但分红增加。"), (9, "科技创新与人工智能成为行业热点，芯片龙头突破新高。"),
]
_ZH_SQL = "z AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in _ZH_ROWS) + ") v(id, text))"


def _zh(spark):
    return spark.createDataFrame(_ZH_ROWS, "id int, text string")


@query(f"""WITH {_ZH_SQL}, s AS (SELECT *, {_count('text', ZH.positive_short)} AS p, {_count('text', ZH.negative_short)} AS n FROM z), c AS (SELECT id, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS score, text FROM s)
    SELECT id, {_r('score')} AS score, {_rules_sql(ZH.news_types, ZH.news_type_default, 0.3)[0]} AS news_type, {_rules_sql(ZH.industries, ZH.industry_default, 0.3)[0]} AS industry,
           {_r("greatest(-0.5, least(0.5, " + " + ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for p, v in ZH.shifts) + "))")} AS adjustment FROM c""")
def chinese_features(spark, d):
    from tessella.functions import classify, features

    z = classify.classify(_zh(spark), F.col("text"), ZH)
    return z.select("id", r(features.sentiment(F.col("text"), ZH)["score"]).alias("score"), F.col("news_type.category").alias("news_type"), F.col("industry.category").alias("industry"), r(sentiment.financial_adjustment(F.col("text"), ZH)).alias("adjustment"))


def _zh_words_sql() -> str:
    """Longest words from the left, then the characters between them: known words are set apart first, longest first."""
    known = "|".join(segment.dictionary(ZH))
    return f"""m AS (SELECT id, unnest(regexp_extract_all(lower(text), '{known}|[一-龥]|[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{known}|[一-龥]|[\\p{{L}}\\p{{N}}_]+'), 1) AS i FROM z)"""


@query(f"WITH {_ZH_SQL}, {_zh_words_sql()} SELECT id, w AS word, count(*) AS n FROM m WHERE regexp_matches(w, '^[一-龥]{{2,}}$') AND w IN ({', '.join(map(_q, segment.dictionary(ZH)))}) GROUP BY ALL")
def chinese_words(spark, d):
    """The words of the lexicon that the segmenter takes from Chinese text."""
    w = _zh(spark).select("id", F.explode(segment.words(F.col("text"), ZH)).alias("word")).filter(F.col("word").isin(list(segment.dictionary(ZH))))
    # a pair of characters between known words may be no word of the lexicon: the segmenter would have taken it
    return w.groupBy("id", "word").agg(F.count("*").alias("n"))


@query(f"""{WITH} SELECT doc_id, regexp_replace(title, 'that', '**that**', 'gi') AS bold, CASE WHEN n_chars >= 10000 THEN format('{{:.1f}}', n_chars / 10000.0) || '万' WHEN n_chars >= 1000 THEN format('{{:.1f}}', n_chars / 1000.0) || 'K' ELSE CAST(n_chars AS VARCHAR) END AS size,
    CASE WHEN date_diff('hour', publish_time, TIMESTAMP '2024-01-31') = 0 THEN '刚刚' WHEN date_diff('day', publish_time, TIMESTAMP '2024-01-31') < 7 THEN CAST(date_diff('day', publish_time, TIMESTAMP '2024-01-31') AS VARCHAR) || '天前' ELSE strftime(publish_time, '%Y-%m-%d') END AS age FROM articles""")
def display_fields(spark, d):
    return articles(spark, d).select("doc_id", display.bold(F.col("title"), ["that"]).alias("bold"), display.large_number(F.col("n_chars")).alias("size"), display.relative_time(F.col("publish_time"), F.lit(NOW)).alias("age"))


@query("SELECT o_orderkey, 'k' || (o_orderkey % 3) AS kind, CAST(o_orderkey AS VARCHAR) AS page, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS code FROM orders")
def url_parameters(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    code = F.when(k % 2 == 0, F.concat(F.lit("&stock="), F.lpad((k % 1000000).cast("string"), 6, "0"))).otherwise("")
    u = F.concat(F.lit("https://x.example/list?page="), k.cast("string"), F.lit("&kind=k"), (k % 3).cast("string"), code)
    return o.select("o_orderkey", urls.query_param(u, "kind").alias("kind"), F.element_at(urls.query_map(u), "page").alias("page"), urls.stock_code_in_url(F.substring_index(u, "&kind=k", -1)).alias("code"))


@query("SELECT event_id, k FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)")
def decoded_json(spark, d):
    return load(spark, d, "events").select("event_id", F.variant_get(display.decode_json(F.col("props")), "$.k", "long").alias("k"))


@query(f"{WITH} SELECT count(*) FILTER (WHERE length(content) >= 100 AND length(title) >= 10) AS news, count(*) FILTER (WHERE length(content) >= 50 AND length(title) >= 5) AS announcements, count(*) FILTER (WHERE (title <> '' OR content <> '') AND length(title || ' ' || content) >= 10) AS embeddable, CAST(sum(CAST(trim(title) = '' AND trim(content) = '' AS INTEGER) + CAST(length(title) > 500 AS INTEGER) + CAST(length(content) > 50000 AS INTEGER)) AS BIGINT) AS errors FROM articles")
def admitted_items(spark, d):
    a, t, c = articles(spark, d), F.col("title"), F.col("content")
    n = lambda x, name: F.count_if(x).alias(name)
    return a.agg(n(filters.valid_news(), "news"), n(filters.valid_announcement(), "announcements"), n(filters.embeddable(t, c), "embeddable"), F.sum(F.size(filters.document_errors(t, c))).alias("errors"))


@query(f"{WITH} SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(title, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '[^一-龥0-9A-Za-z \\t.,!?;:]', '', 'g')), 'x', 'x') AS kept FROM articles")
def search_texts(spark, d):
    return articles(spark, d).select("doc_id", clean.search_text(F.col("title")).alias("kept"))


# aggregates, search, report -----------------------------------------------------------------------------------------


@query("SELECT floor(avg(CAST(event_type = 'click' AS DOUBLE)) * 1e4 + 0.5) / 1e4 AS positive, floor(avg(CAST(event_type = 'view' AS DOUBLE)) * 1e4 + 0.5) / 1e4 AS negative, floor(avg(CAST(event_type = 'purchase' AS DOUBLE)) * 1e4 + 0.5) / 1e4 AS neutral, floor(avg(value) * 1e4 + 0.5) / 1e4 AS confidence FROM events")
def topic_sentiment(spark, d):
    label = F.when(F.col("event_type") == "click", "positive").when(F.col("event_type") == "view", "negative").when(F.col("event_type") == "purchase", "neutral")
    t = aggregates.topic_sentiment(load(spark, d, "events").select(F.coalesce(label, F.lit("other")).alias("label"), F.col("value").alias("confidence")))
    return t.select(*[r(F.col(c)).alias(c) for c in t.columns])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_orderstatus LIMIT 1")
def dominant_status(spark, d):
    return aggregates.dominant(load(spark, d, "orders"), "o_orderstatus")


@query(f"SELECT o_orderstatus AS value, count(*) AS n, {_r('count(*) * 100.0 / (SELECT count(*) FROM orders)')} AS percentage FROM orders GROUP BY ALL")
def status_distribution(spark, d):
    return aggregates.distribution(load(spark, d, "orders"), "o_orderstatus").withColumn("percentage", r(F.col("percentage")))


@query("SELECT ts, event_type AS service, event_id FROM events WHERE value > 95 ORDER BY ts DESC, event_type, 'request failed ' || event_id LIMIT 25")
def last_errors(spark, d):
    e = load(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("service"), "event_id", F.concat(F.when(F.col("value") > 95, "request failed ").otherwise("ok "), F.col("event_id").cast("string")).alias("message"))
    return aggregates.last_errors(e, 25).select(F.col("timestamp").cast("timestamp_ntz").alias("ts"), "service", "event_id")


@query(f"SELECT i AS pos, {_r('sum(x / (vec_id + 1)) / sum(1.0 / (vec_id + 1))')} AS x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) - 1 AS i FROM embeddings WHERE vec_id < 4) GROUP BY i")
def weighted_vector(spark, d):
    v = load(spark, d, "embeddings").filter("vec_id < 4").withColumn("i", F.col("vec_id"))
    return aggregates.mean_vector(v, "embedding", "weighted").select(F.posexplode("embedding").alias("pos", "x")).withColumn("x", r(F.col("x")))


@query(f"SELECT vec_id, i AS pos, {_r('CASE WHEN i < 64 THEN x / n ELSE 0.0 END')} AS x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[]) || [0.0, 0.0]) AS x, CAST(generate_subscripts(CAST(embedding AS DOUBLE[]) || [0.0, 0.0], 1) AS INTEGER) - 1 AS i, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS n FROM embeddings)")
def padded_units(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(vectors.adjust_dim(vectors.unit(F.col("embedding")), 66)).alias("pos", "x")).withColumn("x", r(F.col("x")))


@query("SELECT vec_id, md5(CAST(vec_id % 50 AS VARCHAR)) AS key, vec_id % 50 % 2 = 0 AS cached FROM embeddings")
def cached_embeddings(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).cast("string").alias("text"))
    cache = spark.range(0, 50, 2).select(F.md5(F.col("id").cast("string")).alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    return vectors.with_cache(e, cache, "text", lambda c: F.array(F.lit(0.0))).select("vec_id", "key", (F.col("embedding")[0] == 1.0).alias("cached"))


@query(f"""{WITH}, {_bm25_sql('title', ['license', 'token'], 't', 'articles')}, {_bm25_sql('content', ['license', 'token'], 'c', 'articles')}, {_bm25_sql('source', ['license', 'token'], 'g', 'articles')}
    SELECT doc_id, {_r('greatest(coalesce(t.score, 0) * 3, coalesce(c.score, 0))')} AS score FROM t FULL JOIN c USING (doc_id)""")
def gateway_search(spark, d):
    a = articles(spark, d).withColumn("tags", F.array("source"))
    return fulltext.gateway_search(a, "license token", "doc_id", L, fuzzy=False).select("doc_id", r(F.col("score")).alias("score"))


@query(f"WITH {_bm25_sql('text', ['license', 'token'], 'b')} SELECT count(*) AS total, {_r('max(score)')} AS max_score FROM b")
def search_totals(spark, d):
    hits = fulltext.bm25(load(spark, d, "documents"), "doc_id", F.col("text"), ["license", "token"], L)
    return search.search_summary(hits).withColumn("max_score", r(F.col("max_score")))


@query(f"{WITH} SELECT 'date' AS facet, strftime(publish_time, '%Y-%m-%d') AS value, count(*) AS n FROM articles GROUP BY ALL UNION ALL (SELECT 'source', source, count(*) AS n FROM articles GROUP BY ALL ORDER BY n DESC, source LIMIT 20)")
def page_facets(spark, d):
    facets, days = search.search_facets(articles(spark, d))
    return facets.unionByName(days.select(F.lit("date").alias("facet"), F.col("date").cast("string").alias("value"), "n"))


@query(f"{WITH}, o AS (SELECT DISTINCT title AS s FROM articles WHERE starts_with(lower(title), 'th') ORDER BY s LIMIT 3), e AS (SELECT unnest(['Th分析报告', 'Th投资机会', 'Th市场趋势', 'Th行业动态', 'Th风险评估']) AS s) SELECT s AS suggestion FROM (SELECT s, 0 AS o FROM o UNION ALL SELECT s, 1 FROM e) ORDER BY o, s LIMIT 5")
def suggestions(spark, d):
    a = articles(spark, d)
    own = fulltext.suggest(a, F.col("title"), "Th", 3)
    extra = spark.createDataFrame([(s,) for s in display.template_suggestions("Th")], "suggestion string")
    return tables.append_until(own, extra, "suggestion", 5)


_PAIRED = "SELECT vec_id AS id, CAST(label AS DOUBLE) / 10 AS s FROM embeddings"


@query(f"WITH v AS ({_PAIRED} WHERE vec_id % 3 = 0), k AS ({_PAIRED} WHERE vec_id % 2 = 0) SELECT CASE WHEN v.id IS NULL THEN 'keyword' WHEN k.id IS NULL THEN 'semantic' ELSE 'keyword,semantic' END AS sources, count(*) AS n FROM v FULL JOIN k USING (id) GROUP BY ALL")
def hit_sources(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10).alias("score")).withColumn("rank", F.row_number().over(Window.orderBy("id")))
    m = tables.merge_hits(e.filter("id % 3 = 0"), e.filter("id % 2 = 0"))
    return m.groupBy(F.array_join("search_sources", ",").alias("sources")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, substring(text, 3, 12)) AND length(text) > 20")
def contained_results(spark, d):
    """Results matched to their documents by id and containment."""
    c = load(spark, d, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    parts = c.filter("length(text) > 20").select("id", F.substring("text", 3, 12).alias("part"))
    return tables.containing(c, parts, "text", "part", "id").select("conv_id", "turn")


@query("SELECT 'keywords' AS cluster, 'k,l' AS members UNION ALL SELECT 'high_relevance', 'r' UNION ALL SELECT 'medium_relevance', 's'")
def topic_clusters(spark, d):
    n = spark.createDataFrame([("k", "keyword", 0.8), ("l", "keyword", 0.8), ("r", "related_topic", 0.6), ("s", "related_topic", 0.3), ("t", "related_topic", 0.1), ("m", "main_topic", 1.0)], "label string, type string, importance double")
    return graph.graph_clusters(n).select("cluster", F.array_join("members", ",").alias("members"))


@query("SELECT 'high attention' AS title, 0.9::DOUBLE AS confidence, 'volume' AS type UNION ALL SELECT 'positive mood', 0.8::DOUBLE, 'sentiment' UNION ALL SELECT 'note dominates', 0.7::DOUBLE, 'classification'")
def topic_insights(spark, d):
    stats = spark.createDataFrame([("positive", 70.0), ("negative", 30.0)], "label string, percentage double")
    classes = spark.createDataFrame([("news_type", "note", 60, 60.0), ("news_type", "list", 40, 40.0), ("industry", "x", 100, 100.0)], "kind string, category string, n int, percentage double")
    return report.insights(stats, classes, 100, "license").select("title", F.col("confidence").cast("decimal(2,1)").cast("double").alias("confidence"), "type")


@query("SELECT o_orderkey AS report_id, 'topic ' || (o_orderkey % 9) AS topic FROM orders WHERE o_orderkey % 9 = 4 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 5")
def saved_reports(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("topic "), (F.col("o_orderkey") % 9).cast("string")).alias("topic"), F.lit("text").alias("summary"), F.col("o_orderdate").alias("created"))
    return report.list_reports(o, "Topic 4", 30, 5).select("report_id", "topic")


@query(f"""{WITH}, {_bm25_sql('title', ['license'], 't', 'articles')}, {_bm25_sql('content', ['license'], 'c', 'articles')}, f AS (SELECT a.*, row_number() OVER (PARTITION BY md5(content || title) ORDER BY doc_id) AS rn FROM articles a JOIN (SELECT doc_id FROM t FULL JOIN c USING (doc_id)) USING (doc_id) WHERE publish_time BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'),
    g AS (SELECT * FROM f WHERE rn = 1 AND NOT (length(title) < 10 AND length(content) < 50) AND (trim(title) <> '' OR trim(content) <> '') AND NOT {_count("lower(title || ' ' || content)", L.report_spam)} >= 3) SELECT 'license' AS topic, least(count(*), 200) AS documents FROM g""")
def monitored_topics(spark, d):
    return report.monitor(articles(spark, d), [report.ReportSpec("license", days=7)], NOW, id_col="doc_id", lexicon=L).select("topic", "documents")


@query(f"WITH a AS (SELECT doc_id, unnest({_analyzed('text')}) AS term FROM documents WHERE lang = 'en'), p AS (SELECT doc_id, term, count(*) AS tf FROM a GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term")
def postings_of_english(spark, d):
    p = fulltext.postings(load(spark, d, "documents").filter("lang = 'en'"), "doc_id", {"text": F.col("text")}, L)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
