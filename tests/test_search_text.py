"""Chinese text, search statistics, stored tables with several writers, and the semantic half of reports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import clean, features, segment
from tessella.lexicons import LATIN_DEMO, ZH_FINANCE
from tessella.operators import fulltext, vectors
from tessella.plans import ingest, report, search
from tessella.schemas import ddl
from tessella.sources import store

NOW = datetime(2024, 3, 31, 12)
TEXT = "央行宣布降准，新能源汽车板块上涨，涨停板增多"


def one(spark, c, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(c.alias("x")).first().x


def test_chinese_keywords_are_words(spark):
    got = one(spark, features.keywords_array(F.col("t"), 20), t=TEXT)
    assert {"央行", "降准", "新能源", "汽车", "板块", "上涨", "涨停板"} <= set(got)
    assert features.keywords_array(F.col("t")) is not None and one(spark, F.size(features.keywords_array(F.col("t"))), t="的 了 在") == 0


def test_words_of_a_query_equal_those_of_a_column(spark):
    for text in (TEXT, "Mixed 文本 with ETF基金 and 人工智能ABC", "", "一", "量化宽松政策", "plain latin_text 12"):
        assert one(spark, segment.words(F.col("t")), t=text) == segment.words_of(text)


def test_latin_words_are_tokens(spark):
    assert segment.dictionary(LATIN_DEMO) == ()
    for text in ("The quick, brown fox's 12 tails", "über straße é1", ""):
        assert one(spark, segment.words(F.col("t"), LATIN_DEMO), t=text) == one(spark, segment.tokens(F.col("t")), t=text)


def test_chinese_synonyms_and_stopwords(spark):
    assert fulltext.query_tokens("涨停板 证券") == ["涨停", "股票"]
    assert fulltext.query_tokens("市盈率 PE") == ["市盈率"]
    assert "公司" not in one(spark, fulltext.analyze(F.col("t")), t="公司公告利好")
    assert "涨停" in one(spark, fulltext.analyze(F.col("t")), t="今天涨停板不少")


def test_chinese_search_finds_words_inside_longer_ones(spark):
    d = spark.createDataFrame([(1, "新能源车销量增长"), (2, "央行宣布降准"), (3, "无关内容")], "id int, t string")
    hit = lambda q: {r.id for r in fulltext.bm25(d, "id", F.col("t"), fulltext.query_tokens(q)).collect()}
    assert hit("央行 降准") == {2} and hit("新能源车") == {1} and 1 in hit("能源")


def test_statistics_are_of_the_whole_index(spark):
    d = spark.createDataFrame([(1, "a x", "p"), (2, "x y z", "q"), (3, "x", "q"), (4, "w", "p")], "id int, t string, source string")
    every = {r.id: r.score for r in fulltext.bm25(d, "id", F.col("t"), ["x"], LATIN_DEMO).collect()}
    some = {r.id: r.score for r in fulltext.bm25(d, "id", F.col("t"), ["x"], LATIN_DEMO, where=F.col("source") == "q").collect()}
    assert some == {k: v for k, v in every.items() if k in (2, 3)}
    docs = d.select(F.col("id").cast("string").alias("id"), F.col("t").alias("title"), F.lit("").alias("content"), "source")
    page = search.search(docs, search.SearchSpec("x", filters={"source": "q"}), NOW, lexicon=LATIN_DEMO).collect()
    assert {r.id: r.score for r in page} == pytest.approx({str(k): 3 * v for k, v in some.items()})


def test_more_like_this_by_hand(spark):
    d = spark.createDataFrame([(1, "apple pear plum"), (2, "apple pear"), (3, "plum"), (4, "kiwi")], "id int, t string")
    assert {r.id for r in fulltext.more_like_this(d, "id", 1, F.col("t"), LATIN_DEMO).collect()} == {2, 3}
    assert fulltext.more_like_this(d, "id", 99, F.col("t"), LATIN_DEMO).count() == 0
    t = {r.term: (r.tf, r.df) for r in fulltext.like_this_terms(d, "id", 1, F.col("t"), LATIN_DEMO).collect()}
    assert t == {"apple": (1, 2), "pear": (1, 2), "plum": (1, 2)}


def test_every_entity_is_decoded(spark):
    d = spark.createDataFrame([("&euro;5 &#8364; &lt;b&gt; fish &amp; chips &hellip;", "first line of text &copy;\n&amp;lt;i&amp;gt; stays as text here")], "title string, content string")
    got = clean.clean_documents(d, LATIN_DEMO).first()
    assert got.title == "€5 € fish & chips …" and "©" in got.content and "&lt;i&gt; stays" in got.content


KV = ddl("k long, v string")


def rows(spark, *kv):
    return spark.createDataFrame(list(kv), KV)


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (store.Table(spark, str(tmp_path / "t"), KV, "k") for _ in range(2))
    a.append(rows(spark, (1, "a"), (2, "b")))
    number, parts, batches = b._state()
    a.upsert(rows(spark, (2, "B")))
    with pytest.raises(store.Conflict):
        b._commit(number + 1, parts, batches)
    b.upsert(rows(spark, (3, "c")))
    assert sorted(map(tuple, a.read().collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_a_lost_race_is_run_again(spark, tmp_path, monkeypatch):
    t = store.Table(spark, str(tmp_path / "t"), KV, "k")
    t.append(rows(spark, (1, "a"), (2, "b")))
    commit, lost = store.Table._commit, []

    def first_loses(self, *args):
        if not lost:
            lost.append(1)
            commit(store.Table(spark, self.path, KV, "k"), args[0], [*args[1][:1], [self._write(rows(spark, (9, "z"))), "rows"]], [])
        return commit(self, *args)

    monkeypatch.setattr(store.Table, "_commit", first_loses)
    t.update(rows(spark, (1, "A")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "A"), (2, "b"), (9, "z")]


def test_repeated_batches_and_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "DELTAS", 3)
    t = store.Table(spark, str(tmp_path / "t"), KV, "k")
    for _ in range(2):
        t.append(rows(spark, (1, "a")), batch="one")
        t.upsert(rows(spark, (2, "b")), batch="two")
    assert t.count() == 2
    for i in range(2 * store.DELTAS):
        t.upsert(rows(spark, (i % 5, str(i))))
        assert len(t._state()[1]) <= store.DELTAS
    assert {r.k: r.v for r in t.read().collect()} == {i % 5: str(i) for i in range(2 * store.DELTAS)}
    t.vacuum(1)
    assert len(t._marks()) == 1 and t.count() == 5


def test_report_joins_words_and_vectors(spark):
    body = "long enough body text of the document about something " * 3
    d = spark.createDataFrame([("1", "license terms of the product", body, datetime(2024, 3, 30), [1.0, 0.0]), ("2", "quite another title here", body, datetime(2024, 3, 30), [0.9, 0.1]), ("3", "third title without it", body + "x", datetime(2024, 3, 30), [0.0, 1.0])], "id string, title string, content string, publish_time timestamp, embedding array<double>")
    spec = report.ReportSpec("license", days=7)
    assert {r.id for r in report.collect_documents(d, spec, NOW, lexicon=LATIN_DEMO).collect()} == {"1"}
    assert {r.id for r in report.collect_documents(d, spec, NOW, lexicon=LATIN_DEMO, cap=2, query_vector=[1.0, 0.0]).collect()} == {"1", "2"}


def test_vectors_ties_models_and_components(spark):
    d = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id int, v array<double>").repartition(3)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, query array<double>")
    assert [r.id for r in vectors.batch_top_k(d, q, "id", "v", 5, block=4).orderBy("rank").collect()] == [0, 1, 2, 3, 4]

    def broken():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    t = spark.createDataFrame([("some text",), ("",)], "t string")
    failed = spark.sparkContext.accumulator(0)
    assert [sum(r.e) for r in t.select(vectors.model_embedding(F.col("t"), broken, 3, failed).alias("e")).collect()] == [0, 0] and failed.value >= 1
    with pytest.raises(Exception, match="no model"):
        t.select(vectors.model_embedding(F.col("t"), broken, 3).alias("e")).collect()
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3} w{i % 4} gamma{i % 2}") for i in range(24)], "id int, t string")
    e = vectors.tfidf_embedding(docs, "id", F.col("t"), 4).collect()
    assert len(e) == 24 and {len(r.embedding) for r in e} == {4}


def test_stages_by_name_and_summaries(spark):
    ingest.register_stage("shout", lambda df: df.withColumn("title", F.upper("title")))
    d = spark.createDataFrame([("1", "a title of some length", "Body text with words. " * 20, "https://x.y/1", "s", datetime(2024, 3, 1))], "id string, title string, content string, url string, source string, publish_time timestamp")
    got = ingest.process(d, ingest.Options(lexicon=LATIN_DEMO, quality_threshold=0.1, extra_stages=["shout"])).final.first()
    assert got.title == "A TITLE OF SOME LENGTH"
    kinds = {r.kind: r.percentage for r in ingest.nlp_distributions(ingest.nlp(d, ingest.Options(lexicon=LATIN_DEMO))).collect()}
    assert kinds == {"sentiment": 100.0, "news_type": 100.0, "industry": 100.0, "importance_level": 100.0}
    assert ZH_FINANCE.entity_terms and not LATIN_DEMO.entity_terms
