from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.lexicons import LATIN_DEMO, ZH_FINANCE
from tessella.operators import aggregates, dedup, filters, fulltext, graph, tables, vectors

NOW = datetime(2024, 3, 31, 12)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("a", "央行宣布降准 释放流动性", "中国人民银行今日宣布降准0.5个百分点，市场普遍看好。" * 3, "src1", datetime(2024, 3, 30), ["宏观", "央行"], 0.9),
        ("b", "新能源汽车销量增长", "比亚迪新能源汽车销量大幅增长，板块上涨明显，行业景气度提升。" * 3, "src2", datetime(2024, 3, 1), ["汽车"], 0.5),
        ("c", "公司公告：业绩亏损", "某公司公告净利润亏损，股价跌停，风险较大。" * 4, "src1", None, [], 0.2),
    ]
    return spark.createDataFrame(rows, "id string, title string, content string, source string, publish_time timestamp, tags array<string>, quality_score double")


def test_search_filters(docs):
    f = lambda s: ids(docs.filter(filters.search_filter(s, NOW)))
    assert f({}) == ["a", "b", "c"] and f({"unknown": 1}) == ["a", "b", "c"]
    assert f({"source": "src1"}) == ["a", "c"] and f({"source": ["src2"]}) == ["b"]
    assert f({"date_range": {"preset": "week"}}) == ["a"] and f({"date_range": {"preset": "month"}}) == ["a"]
    assert f({"date_range": {"preset": "year", "end": datetime(2024, 3, 2)}}) == ["b"]
    assert f({"score_range": {"min": 0.5, "max": 0.5}}) == ["b"]
    assert f({"tags": ["央行", "x"]}) == ["a"]
    assert filters.preset_start("today", NOW) == datetime(2024, 3, 31) and filters.preset_start("x", NOW) is None


def test_payload_and_text_filters(docs):
    assert ids(docs.filter(filters.payload_filter({"quality_score": {"range": {"gte": 0.5}}, "source": ["src1", "src2"], "odd": {"x": 1}}))) == ["a", "b"]
    assert ids(docs.filter(filters.excludes(["风险"], F.col("title"), F.col("content")))) == ["a", "b"]
    assert ids(docs.filter(filters.newer_than(F.col("publish_time"), F.lit(datetime(2024, 3, 1))))) == ["a"]
    assert filters.input_errors(docs) == [] and filters.input_errors(docs.drop("title")) == ["missing column: title"] and filters.input_errors(docs.limit(0)) == ["no documents"]


def test_url_admission(spark):
    u = spark.createDataFrame([("http://x/news/1.html",), ("http://x/NEWS/a.PDF",), ("http://x/video/news/",), ("",), (None,), ("http://x/about",)], "u string")
    assert [r.u for r in u.filter(filters.news_url(F.col("u"))).collect()] == ["http://x/news/1.html"]
    assert [r.u for r in u.filter(filters.announcement_url(F.col("u"))).collect()] == ["http://x/NEWS/a.PDF"]


def test_validation(spark):
    d = spark.createDataFrame([("", ""), ("t" * 501, "c"), ("t", "c")], "title string, content string")
    assert [len(r.e) for r in d.select(filters.document_errors(F.col("title"), F.col("content")).alias("e")).collect()] == [1, 1, 0]
    assert [r.e for r in d.select(filters.embeddable(F.col("title"), F.col("content")).alias("e")).collect()] == [False, True, False]


def test_snapshot_diff_invariants(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, hash string")
    c = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "doc_id string, hash string")
    assert {r.doc_id: r.change for r in tables.snapshot_diff(p, c).collect()} == {"a": "deleted", "b": "unchanged", "c": "updated", "d": "created"}
    assert {r.change for r in tables.snapshot_diff(p, p).collect()} == {"unchanged"}
    assert {r.change for r in tables.snapshot_diff(p.limit(0), c).collect()} == {"created"}
    assert "deleted" not in {r.change for r in tables.snapshot_diff(p, c, full=False).collect()}
    assert tables.change_summary(tables.snapshot_diff(p, c)).first().total_changes == 3


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "z", 7)], "id int, name string, n int")
    assert sorted(map(tuple, tables.upsert(old, new, "id").collect())) == [(1, "x", 5), (2, None, 9), (3, "z", 7)]
    assert sorted(map(tuple, tables.partial_update(old, new, "id").collect())) == [(1, "x", 5), (2, "y", 9), (3, "z", 7)]
    assert ids(tables.delete_by_query(old, F.when(F.col("id") == 1, True))) == [2]
    assert ids(tables.delete_by_id(old, new, "id")) == [1]
    wins = tables.resolve_conflicts(old, new.withColumn("n", F.lit(6)), "id", "n")
    assert {r.id: r.name for r in wins.collect()} == {1: "x", 2: None, 3: "z"}
    assert tables.resolve_conflicts(old, new, "id", "n", "skip").count() == 3 and tables.resolve_conflicts(old, new, "id", "n", "manual").filter("conflict").count() == 2


def test_merge_lists_and_paging(spark):
    a = spark.createDataFrame([("1", "t", "c"), ("2", "u", "d")], "id string, title string, content string")
    b = spark.createDataFrame([("1", "x", "y"), ("9", "t", "c"), (None, "n", "n")], "id string, title string, content string")
    assert {(r.id, r.title) for r in tables.merge_lists(a, b).collect()} == {("1", "t"), ("2", "u"), (None, "n")}
    n = spark.range(300)
    assert [r.id for r in tables.page(n, [F.asc("id")], 2, 299).collect()] == [299] and tables.page(n, [F.asc("id")], 500).count() == 100 and tables.page(n, [F.asc("id")], 0).count() == 0
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "s string")
    assert [r.s for r in tables.append_until(s("b", "a"), s("a", "c", "d"), "s", 3).collect()] == ["a", "b", "c"]


def test_merge_hits(spark):
    v = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 2)], "id string, score double, rank int")
    k = spark.createDataFrame([("b", 1.0, 1), ("c", 0.4, 2)], "id string, score double, rank int")
    got = {r.id: r for r in tables.merge_hits(v, k).collect()}
    assert got["a"].keyword_rank == 3 and got["c"].vector_rank == 3 and got["b"].score == pytest.approx(0.65) and got["b"].search_sources == ["keyword", "semantic"]


def test_anomalies(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=i), 0, 0.0, 0.0) for i in range(20)]
    rows[10] = (rows[10][0], 50, 0.0, 0.0)
    rows[15] = (rows[15][0], 0, -0.9, 0.0)
    t = spark.createDataFrame(rows, "date timestamp, volume long, sentiment double, importance double").withColumn("date", F.to_date("date"))
    got = {r.date.day: r for r in aggregates.anomalies(t).collect()}
    assert got[11].anomaly and got[11].anomaly_reason.startswith("volume") and got[16].anomaly_reason == "sentiment:low" and not got[1].anomaly
    flat = t.withColumn("volume", F.lit(1))
    assert all(r.anomaly and r.anomaly_score in (0.6, 1.0) for r in aggregates.anomalies(flat).collect())
    two = t.limit(2).withColumn("volume", F.lit(9))
    assert not any(r.anomaly for r in aggregates.anomalies(two).collect())


def test_runs_of_active_days(spark):
    pattern = [1, 1, 0, 1, 1, 1]
    t = spark.createDataFrame([(datetime(2024, 1, 1 + i), v, 0.0) for i, v in enumerate(pattern)], "date timestamp, volume long, importance double")
    assert [r.run_length for r in aggregates.active_runs(t).orderBy("date").collect()] == [2, 2, 0, 3, 3, 3]


def test_trend_fills_empty_days(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 2), 0.5)], "ts timestamp, s double")
    got = aggregates.daily_trend(e, "ts", F.col("s"), F.lit(1.0), F.lit("2024-01-01"), F.lit("2024-01-03")).orderBy("date").collect()
    assert [(r.volume, r.value) for r in got] == [(0, 50.0), (1, 75.2), (0, 50.0)]


def test_facets_break_ties_by_value(spark):
    d = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "source string")
    assert [(r.value, r.n) for r in aggregates.facets(d, {"source": 2}).orderBy(F.desc("n")).collect()] == [("c", 2), ("a", 1)]


def test_bm25_by_hand(spark):
    import math

    d = spark.createDataFrame([(1, "x y"), (2, "x x z w"), (3, "q")], "id int, t string")
    got = {r.id: r.score for r in fulltext.bm25(d, "id", F.col("t"), ["x"], ZH_FINANCE).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    s = lambda tf, dl: idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 3)))
    assert got == pytest.approx({1: s(1, 2), 2: s(2, 4)})
    p = fulltext.postings(d, "id", {"t": F.col("t")})
    again = fulltext.bm25_from_postings(p, fulltext.field_lengths(d, "id", {"t": F.col("t")}), "id", "t", ["x"]).collect()
    assert {r.id: r.score for r in again} == pytest.approx(got)
    assert fulltext.bm25(d, "id", F.col("t"), []).count() == 0


def test_analysis_folds_synonyms_and_stopwords(spark):
    d = spark.createDataFrame([("Equity 的 fund",)], "t string")
    assert d.select(fulltext.analyze(F.col("t"), ZH_FINANCE).alias("x")).first().x == ["基金"]  # the folded synonym is a stopword of the index side
    assert d.select(fulltext.analyze(F.col("t"), ZH_FINANCE, stop=False).alias("x")).first().x == ["股票", "的", "基金"]
    assert fulltext.query_tokens("Le the x", LATIN_DEMO) == ["the", "x"]


def test_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.6, 0.8]), (5, [1.0])], "id int, v array<float>")
    top = vectors.top_k(d, "id", "v", [1.0, 0.0], 3).collect()
    assert [(r.id, round(r.score, 6)) for r in top] == [(1, 1.0), (3, 1.0), (4, 0.6)]
    assert [r.id for r in vectors.top_k(d, "id", "v", [1.0, 0.0], 5, threshold=1.0).collect()] == [1, 3]
    assert [r.id for r in vectors.similar_to(d, "id", "v", 1, 1).collect()] == [3] and vectors.similar_to(d, "id", "v", 99, 1).count() == 0
    assert vectors.combine([[1, 0], [0, 1]], "weighted") == pytest.approx([2 / 3, 1 / 3]) and vectors.combine([[1, 0], [0, 2]], "max") == [1, 2]
    two = d.filter("id < 5")
    q = two.select(F.col("id").alias("query_id"), F.col("v").alias("query")).filter("query_id = 4")
    assert [r.id for r in vectors.batch_top_k(two, q, "id", "v", 2).orderBy("rank").collect()] == [4, 1]
    e = spark.createDataFrame([("abc abc",), ("",)], "t string").select(vectors.hashed_embedding(F.col("t"), 8).alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1) and sum(e[1].e) == 0
    assert spark.range(1).select(vectors.adjust_dim(F.array(F.lit(1.0)), 3).alias("x")).first().x == [1.0, 0.0, 0.0]
    cached = vectors.with_cache(spark.createDataFrame([("a",), ("b",)], "t string"), spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", [7.0])], "key string, embedding array<double>"), "t", lambda c: F.array(F.lit(1.0)))
    assert {r.t: r.embedding for r in cached.collect()} == {"a": [7.0], "b": [1.0]}


def test_similar_pairs_equal_brute_force(spark):
    import itertools

    texts = ["aa bb cc dd ee ff", "aa bb cc dd ee gg", "aa bb cc dd ee ff", "xx yy zz", "xx yy zz ww", "qq"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    v = {}
    for r in vectors.tfidf_terms(d, "id", F.col("t")).collect():
        v.setdefault(r.id, {})[r.term] = r.weight
    for limit in (0.3, 0.6, 0.9):
        want = {(a, b) for a, b in itertools.combinations(v, 2) if sum(w * v[b].get(t, 0) for t, w in v[a].items()) >= limit}
        for block in (2, 100):
            assert {(r.a, r.b) for r in dedup.similar_pairs(d, "id", F.col("t"), limit, block=block).collect()} == {tuple(sorted(p)) for p in want}
        links, pairs = (dedup.clusters(f(d, "id", F.col("t"), limit, block=2)).collect() for f in (dedup.similar_links, dedup.similar_pairs))
        assert sorted(map(tuple, links)) == sorted(map(tuple, pairs))


def test_similar_classes_count_every_link(spark, monkeypatch):
    import itertools
    import random

    from tessella.operators import similar

    monkeypatch.setattr(similar, "FILE_ROWS", 8)  # several files of blocks
    rng = random.Random(3)
    texts = [" ".join(rng.choice(base) if rng.random() < 0.2 else w for w in base) for base in (["aa bb cc dd ee ff gg hh"] * 3 + ["kk ll mm nn oo pp"] * 2) for base in [base.split()] for _ in range(8)]
    texts += texts[:5] + texts[:3] + ["", None, "x y", "AA bb cc dd ee ff gg hh"]
    d = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "id int, t string")
    v = {}
    for r in vectors.tfidf_terms(d, "id", F.col("t")).collect():
        v.setdefault(r.id, {})[r.term] = r.weight
    links = [(a, b) for a, b in itertools.combinations(sorted(v), 2) if sum(w * v[b].get(t, 0) for t, w in v[a].items()) >= 0.7 - 1e-9]
    label = {r.id: r.id for r in d.collect()}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = {i: (label[i], sum(i in p for p in links)) for i in label}
    assert 0 < len({c for c, n in want.values() if n}) < len(want)
    assert {r.id: (r.class_id, r.n_links) for r in dedup.similar_classes(d, "id", F.col("t"), 0.7, block=4).collect()} == want


def test_deduplicate_partitions_its_input(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "h1", text, 10, datetime(2024, 1, 1), 0.1), (2, "h1", text, 10, datetime(2024, 1, 2), 0.1), (3, "h3", text + " lambda", 11, datetime(2024, 1, 3), 0.1), (4, "h4", "quite another text here", 4, None, 0.5), (5, "old", "seen before", 2, None, 0.5)]
    d = spark.createDataFrame(rows, "id int, content_hash string, content string, word_count int, publish_time timestamp, importance_score double")
    seen = spark.createDataFrame([("old",)], "content_hash string")
    got = {r.id: (r.dup_kind, r.dup_of) for r in dedup.deduplicate(d, "id", F.col("content"), threshold=0.8, seen=seen).collect()}
    assert got == {1: ("near", "3"), 2: ("exact", "1"), 3: (None, None), 4: (None, None), 5: ("exact", "")}
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a int, b int")
    assert {r.node: r.label for r in dedup.clusters(chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_graph(docs):
    a = docs
    nodes = {r.label: r for r in graph.graph_nodes(a, "公司", ["亏损", "公司"], ["板块", "增长", "zz"], F.col("title"), F.col("content")).collect()}
    assert set(nodes) == {"公司", "亏损"} and nodes["公司"].size == 30
    e = graph.cooccurrence(a, [("公司", "亏损"), ("zz", "yy")], F.concat("title", "content")).collect()
    assert [r.jaccard for r in e] == [1.0, 0.0]
    assert graph.graph_edges(a, "公司", ["亏损"], [], F.concat("title", "content")).first().width == 5.0
    n = a.sparkSession.createDataFrame([("k", "keyword", 0.8), ("r", "related_topic", 0.6), ("s", "related_topic", 0.3), ("t", "related_topic", 0.1)], "label string, type string, importance double")
    assert {r.cluster for r in graph.graph_clusters(n).collect()} == {"keywords", "high_relevance", "medium_relevance"}
