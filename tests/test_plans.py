from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import queries
from tessella.engine import Engine
from tessella.lexicons import LATIN_DEMO
from tessella.plans import ingest, report, search
from tessella.schemas import PROCESSED, RAW_DOCUMENTS, conform
from tessella.sources import logs, pages, store
from tessella.streaming import incremental

NOW = datetime(2024, 3, 31, 12)
SF = "/root/testdata/sf0.001"


def raw(spark):
    body = "中国人民银行宣布下调存款准备金率0.5个百分点，释放长期资金约1万亿元。市场普遍认为这一政策利好股市。投资者情绪明显回升，银行板块上涨2.5%。"
    rows = [
        ("1", "news", "央行宣布降准 释放流动性", f"<p>{body}</p>\n<p>2024年3月30日，多家机构发布分析报告，看好后市增长。</p>", "https://a.cn/news/1.html#top", "新华", "news", datetime(2024, 3, 30)),
        ("2", "news", "央行宣布降准 释放流动性", f"<p>{body}</p>\n<p>2024年3月30日，多家机构发布分析报告，看好后市增长。</p>", "https://b.cn/news/2.html", "转载", "news", datetime(2024, 3, 30)),
        ("3", "news", "新能源汽车销量创新高", "比亚迪公布销量数据，新能源汽车行业景气度提升，板块上涨。\n分析师推荐买入相关股票，但也提示竞争风险。", "https://a.cn/news/3.html", "新华", "news", datetime(2024, 3, 28)),
        ("4", "news", "", "", "", "", "news", None),
    ]
    df = spark.createDataFrame(rows, "id string, type string, title string, content string, url string, source string, category string, publish_time timestamp")
    return conform(df, RAW_DOCUMENTS)


def test_pipeline_partitions_its_input(spark):
    r = ingest.process(raw(spark), ingest.Options(quality_threshold=0.5))
    final, dup, low = ({x.id for x in d.select("id").collect()} for d in (r.final, r.duplicates, r.low_quality))
    assert final == {"1", "3"} and dup == {"2"} and low == {"4"}
    assert r.counts() == {"processed": 4, "duplicates": 1, "high_quality": 2, "low_quality": 1}
    one = r.final.filter("id = '1'").first()
    assert one.url == "https://a.cn/news/1.html" and "<p>" not in one.content and one.quality.overall > 0.5 and one.sentiment.label == "positive"
    assert '"processed": 4' in ingest.report(r)
    conform(r.final, PROCESSED).count()


def test_nlp_features(spark):
    got = {r.id: r for r in ingest.nlp(raw(spark)).collect()}
    assert got["3"].industry.category == "汽车" and any(e.text == "比亚迪" for e in got["3"].recognized_entities)
    assert got["4"].recognized_entities == [] and got["4"].news_type.category == "其他"


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    assert e.ingest(raw(spark), quality_threshold=0.5)["high_quality"] == 2
    assert e.documents.count() == 2 and e.documents.exists("1") and not e.documents.exists("9")
    hits = e.search(search.SearchSpec("央行 降准"), NOW).collect()
    assert [h.id for h in hits][:1] == ["1"] and "content" not in hits[0].asDict()
    assert {h.id for h in e.search(search.SearchSpec("新能源汽车", mode="hybrid"), NOW).collect()} >= {"3"}
    assert [h.id for h in e.search(search.SearchSpec("新能源汽车销量", mode="semantic"), NOW).collect()][0] == "3"
    assert e.search(search.SearchSpec("央行", filters={"source": "none"}), NOW).count() == 0
    assert e.suggest("央行", 3).count() == 3
    assert [r.id for r in e.similar("1", 1, threshold=None).collect()] == ["3"]
    assert e.more_like("1").count() <= 1
    rep = e.report(report.ReportSpec("央行", ("降准",), 7), NOW)
    assert rep.trend.count() == 8 and "央行" in report.export_text(rep, "央行") and rep.nodes.filter("type = 'main_topic'").count() == 1
    e.ingest(raw(spark), quality_threshold=0.5)
    assert e.documents.count() == 2
    assert e.statistics()["documents"]["rows"] == 2


def test_specs_validate_eagerly():
    for bad in ({"query": ""}, {"query": "x" * 201}, {"query": "x", "mode": "z"}, {"query": "x", "page": 0}, {"query": "x", "page_size": 101}, {"query": "x", "sort": "z"}):
        with pytest.raises(ValueError):
            search.SearchSpec(**bad)
    with pytest.raises(ValueError):
        report.ReportSpec("x", days=366)


def test_table_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), incremental.SNAPSHOT, "doc_id")
    assert t.read().count() == 0 and t.version() is None
    row = lambda i, h: spark.createDataFrame([(i, h, NOW, "u", "t", "s")], incremental.SNAPSHOT)
    t.append(row("a", "1"))
    t.append(row("b", "2"))
    t.upsert(row("a", "9"))
    t.update(row("c", "3"))
    assert {r.doc_id: r.hash for r in t.read().collect()} == {"a": "9", "b": "2", "c": "3"}
    t.delete(row("b", ""))
    t.delete_where(F.col("hash") == "3")
    assert [r.doc_id for r in t.list().collect()] == ["a"]
    t.backup(str(tmp_path / "b"))
    t.truncate()
    assert t.count() == 0
    t.restore(str(tmp_path / "b"))
    t.compact()
    t.vacuum(1)
    assert len(t._marks()) == 1
    assert t.stats()["rows"] == 1 and t.get("a").first().hash == "9"


def test_change_detection(spark, tmp_path):
    d = incremental.ChangeDetector(spark, str(tmp_path / "c"))
    now = F.lit(NOW)
    docs = raw(spark).filter("id in ('1', '3')")
    first = d.detect(docs, now)
    assert {r.change for r in first.collect()} == {"created"}
    d.commit(docs, first, now)
    assert {r.change for r in d.detect(docs, now).collect()} == {"unchanged"}
    changed = docs.withColumn("content", F.when(F.col("id") == "3", "x").otherwise(F.col("content"))).filter("id = '3'")
    assert {(r.doc_id, r.change) for r in d.detect(changed, now).collect()} == {("1", "deleted"), ("3", "updated")}
    inc = d.detect(changed, now, full=False, since=NOW - timedelta(days=10))
    assert [(r.doc_id, r.change) for r in inc.collect()] == [("3", "updated")]
    d.commit(changed, inc, now, full=False)
    assert d.snapshot.count() == 2 and d.history().count() == 2 and d.totals().first().created == 2
    target = store.Table(spark, str(tmp_path / "target"), RAW_DOCUMENTS, "id")
    incremental.apply_changes(docs, first, target)
    assert target.count() == 2


def test_streams(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    raw(spark).limit(3).coalesce(1).write.mode("overwrite").json(str(land))
    t = store.Table(spark, str(tmp_path / "t"), RAW_DOCUMENTS, "id")
    for _ in range(2):  # a restart reads nothing twice
        q = incremental.start_upserts(incremental.landing(spark, str(land)), t, str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert t.count() == 3
    s = incremental.dedup_stream(incremental.landing(spark, str(land)), ["url"], "publish_time")
    q = s.writeStream.format("memory").queryName("dd").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dd").count() == 3


def test_windowed_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    batch = incremental.windowed_counts(e, "ts", ["event_type"]).collect()
    stream = incremental.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, batch))


def test_sync_manager(spark):
    m, got = incremental.SyncManager(spark), []
    m.register("ok", lambda s, since: s.range(3), lambda df: got.append(df.count()))
    m.register("bad", lambda s, since: 1 / 0, lambda df: None)
    assert m.tick(NOW) == []
    m.start()
    assert m.tick(NOW) == ["ok"] and got == [3] and m.sources["ok"]["mark"] == NOW and m.sources["bad"]["mark"] is None
    assert m.tick(NOW + timedelta(minutes=1)) == [] and m.status()["errors"] == 2
    m.disable("bad")
    m.pause()
    assert m.tick(NOW + timedelta(days=1)) == []


def test_logs(spark, tmp_path):
    (tmp_path / "api.log").write_text("2024-01-01 10:00:00 ERROR x failed\n\nplain line\n[2024-01-01 11:00:00] warn slow\n")
    rows = logs.read_logs(spark, str(tmp_path / "api.log"), F.lit(datetime(2024, 1, 2)))
    assert rows.count() == 3 and {r.service for r in rows.collect()} == {"api"} and {r.level for r in rows.collect()} == {"ERROR", None, "WARN"}
    assert logs.retain(rows, 2).count() == 1 and logs.retain(rows, 5).count() == 3


def test_pages(spark):
    html = '<html><head><title>T</title></head><body><h1>新闻标题足够长的一个例子</h1><span class="author">张三</span><span class="date">2024-01-02</span><div class="article-content"><p>' + "正文内容" * 40 + '</p></div><a href="/news/9.html">x</a></body></html>'
    d = spark.createDataFrame([(1, "https://a.cn/news/2024/01/02/1.html", html)], "page_id int, url string, html string")
    got = pages.news_items(pages.parse_pages(d)).first()
    assert got.author == "张三" and got.publish_time == datetime(2024, 1, 2) and got.content.startswith("正文") and got.domain == "a.cn"
    assert pages.page_links(d).first().link == "https://a.cn/news/9.html"
    assert pages.next_pages(d, 3).count() == 3
    assert pages.parse_pages_html(d).first().parsed_text.startswith("新闻标题")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "events", "embeddings", "customer", "orders", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def plain(v):
        if isinstance(v, float):
            return round(v, 4) + 0.0
        return v

    a = sorted([tuple(str(plain(v)) for v in r) for r in got.select(*cols).collect()])
    b = sorted([tuple(str(plain(float(v) if type(v).__name__ == "Decimal" else v)) for v in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()])
    assert len(a) == len(b)
    norm = lambda rows: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows]
    assert sorted(norm(a)) == sorted(norm(b))


def test_lexicon_is_a_parameter():
    assert LATIN_DEMO.name == "latin_demo"


def test_queries_run_near_duplicates_and_keywords(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 600 and 3000").orderBy("doc_id").limit(8)
    near = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat("text", F.lit(" the"))})
    docs.unionByName(near).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {int(r.id) for r in queries.QUERIES["ingest_pipeline"](spark, str(tmp_path)).collect()}
    assert ids and not any(i % 1_000_000 == j % 1_000_000 for i in ids for j in ids if i < j)
    rows = queries.QUERIES["nlp_features"](spark, str(tmp_path)).collect()
    assert len(rows) == 16 and all(r.keywords > 0 for r in rows)


def test_features_are_extracted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(id):
        seen.add(1)
        return 1

    n = raw(spark).count()
    r = ingest.process(raw(spark), ingest.Options(extra_stages=[lambda df: df.withColumn("word_count", F.col("word_count") * count("id"))]))
    assert r.counts()["processed"] == n and r.final.count() + r.duplicates.count() + r.low_quality.count() == n
    assert seen.value == n
