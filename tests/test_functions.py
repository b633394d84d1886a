from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import clean, classify, display, entities, features, quality, segment, sentiment, urls
from tessella.lexicons import LATIN_DEMO, ZH_FINANCE


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'timestamp' if isinstance(v, datetime) else 'string'}" for k, v in cols.items())).select(expr.alias("x")).first()
    return row.x


@pytest.mark.parametrize("raw,want", [
    (None, ""), ("", ""), ("  a \n b ", "a b"), ("<b>涨停板</b> x", "涨停 x"), ("a &lt;b&gt; c", "a c"), ("&amp;lt;i", "&lt;i"), ("see http://x.cn/a?b=1 me@x.com now", "see   now"), ("股票价格和市盈率", "股价和PE"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, clean.clean_text(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw", ["esheha b@c.example.comÓezie", "chßa@b.exampleé.com", "éa.b@c.org x", "a@b.comé.org", "x a@b.org.", "_a@b.com_", "è.a@b.net"])
def test_mail_addresses_end_where_sql_ends_them(spark, raw):
    import duckdb

    from tessella.queries import _clean_sql
    want = duckdb.execute(f"SELECT {_clean_sql('t')} FROM (SELECT ? AS t)", [raw]).fetchone()[0]
    assert one(spark, clean.clean_text(F.col("t"), LATIN_DEMO), t=raw) == want


def test_patterns_are_searched_where_a_match_can_be():
    from tessella.lexicons import ENTITY_OFFSET_PATTERNS as P

    found = {p: entities.needed(p) for ps in P.values() for p in ps}
    assert sum(x is not None and all(not c.isascii() for c in x) for x in found.values()) >= 10
    assert entities.needed("[0-9]+\\.?[0-9]*%") == {"%"} and entities.needed("(?i)ab") is None and entities.needed("a*|b") is None
    assert entities.needed("(?:甲|乙丙)[a-z]*") >= {"甲"} and entities.needed("x(?:甲)?") == {"x"}


def test_keywords_of_a_text_of_many_words(spark):
    import time

    text, began = " ".join(f"w{i % 30_000}" for i in range(60_000)) + " w7", time.time()
    assert one(spark, features.keywords_array(F.col("t"), 3), t=text) == ["w7", "w0", "w1"]
    assert time.time() - began < 30  # a fold that copies its counts takes minutes


def test_clean_text_is_idempotent(spark):
    once = clean.clean_text(F.col("t"))
    for t in ("<p>每股收益 5%</p>\n更多", "A  B\tC", "x@y.zz 市净率"):
        assert one(spark, once, t=t) == one(spark, clean.clean_text(once), t=t)


def test_clean_content(spark):
    html = "<script>var a='</p>';</script><p>第一段内容足够长可以保留下来</p>\n<p>短</p>\n<style>x</style>another paragraph here"
    assert one(spark, clean.clean_content(F.col("t")), t=html) == "第一段内容足够长可以保留下来\nanother paragraph here"
    assert one(spark, clean.clean_content(F.col("t"), keep_lines=False), t="0123456789") == ""
    assert one(spark, clean.clean_content(F.col("t"), keep_lines=False), t="0123456789a") == "0123456789a"


def test_urls_times_ids(spark):
    assert one(spark, clean.normalize_url(F.col("t")), t=" http://a/b#c ") == "http://a/b"
    assert one(spark, clean.parse_timestamp(F.col("t")), t="2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, clean.parse_timestamp(F.col("t")), t="2024-01-02 03:04:05") == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, clean.parse_timestamp(F.col("t")), t="soon") is None
    assert one(spark, clean.parse_timestamp(F.col("t")), t="1704164645000") == datetime(2024, 1, 2, 3, 4, 5)
    now = F.lit("2024-03-02 10:00:00").cast("timestamp")
    assert one(spark, clean.parse_item_date(F.col("t"), now), t="2024年1月5日") == datetime(2024, 1, 5)
    assert one(spark, clean.parse_item_date(F.col("t"), now), t="1月5日") == datetime(2024, 1, 5)
    assert one(spark, clean.parse_item_date(F.col("t"), now), t="昨天") == datetime(2024, 3, 1)
    assert one(spark, urls.date_in_url(F.col("t")), t="/a/2024-05-06/x") == "2024-05-06T00:00:00"
    assert one(spark, urls.stock_code_in_url(F.col("t")), t="x?code=600519&a") == "600519"
    assert one(spark, urls.announcement_id_in_url(F.col("t")), t="/x/778.html") == "778"
    assert one(spark, urls.domain(F.col("t")), t="https://a.cn:80/x") == "a.cn:80"
    assert one(spark, urls.query_param(F.col("t"), "q"), t="https://a.cn/x?q=7&r=8") == "7"
    assert one(spark, urls.links(F.col("t")), t='<a href="/n/1">x</a><A class=z href="/n/2">') == ["/n/1", "/n/2"]


def test_stats_boundaries(spark):
    for n, want in ((0, 0), (1, 1), (199, 1), (200, 1), (399, 1), (400, 2)):
        t = " ".join(["w"] * n)
        got = spark.createDataFrame([(t,)], "t string").select(*[c.alias(k) for k, c in clean.text_stats(F.col("t")).items()]).first()
        assert (got.word_count, got.reading_time, got.char_count) == (n, want, len(t))


def test_item_fields(spark):
    assert one(spark, clean.item_tags(F.col("t")), t="ab,c;def，" + "x" * 21 + " 银行") == ["ab", "def", "银行"]
    assert one(spark, clean.clean_item_text(F.col("t")), t=" a&nbsp;b &amp;  c\x01 ") == "a b & c"
    assert one(spark, clean.take_first(F.array(F.lit(None), F.lit(""), F.col("t"))), t="z") == "z"


def test_features(spark):
    text = "中国平安股份有限公司2024年1月2日公告盈利增长，营收100.5亿元，上涨5.2%，代码600519"
    got = one(spark, features.entities(F.col("t")), t=text)
    assert [(e.type) for e in got] == ["stock_code", "money", "percentage", "date", "company"]
    s = one(spark, features.sentiment(F.col("t")), t=text)
    assert (s.label, s.score) == ("positive", 1.0) and s.confidence == 0.9
    s = one(spark, features.sentiment(F.col("t")), t="无")
    assert (s.label, s.score, s.confidence) == ("neutral", 0.0, 0.5)
    assert one(spark, features.sentiment(F.col("t")), t="上涨下跌").label == "neutral"
    assert one(spark, features.categories(F.col("t")), t="roe提高 证监会") == ["财务指标", "监管政策"]
    assert one(spark, features.categories(F.col("t"), fold_case=False), t="ROE") == ["通用财经"]
    assert one(spark, features.categories(F.col("t")), t="x") == ["通用财经"]
    long = "这是一个长度超过十个字的句子。" * 5
    assert one(spark, features.summary(F.col("c"), F.col("t")), c=long, t="题").count("。") == 3
    assert one(spark, features.summary(F.col("c"), F.col("t")), c="短。", t="题") == "题"
    assert one(spark, features.keywords_array(F.col("t"), 2), t="bb aa aa cc bb dd") == ["bb", "aa"]


def test_importance_bounds(spark):
    got = one(spark, features.importance(F.lit(501), F.lit(9), F.array(F.lit("股票相关")), F.lit(0.8), F.lit(20)), t="")
    assert got == pytest.approx(1.0)
    assert one(spark, features.importance(F.lit(0), F.lit(0), F.array(F.lit("x")), F.lit(0.0), F.lit(0)), t="") == 0


def test_quality(spark):
    c = lambda title, content: one(spark, quality.completeness(F.col("a"), F.col("b"), F.lit("u"), F.lit("s")), a=title, b=content)
    assert c("标题五个字", " ".join("w" * 20)).score == pytest.approx(1.0)
    assert c("标题四字", " ".join("w" * 20)).score == pytest.approx(0.8)
    assert c("标题五个字", " ".join("w" * 19)).score == pytest.approx(0.7)
    assert c("", "").score == pytest.approx(0.1)
    q = lambda t: one(spark, quality.content_quality(F.lit(""), F.col("b")), b=t)
    assert q("").score == 0
    assert "repeats" in q("aaaaaa 一").issues and "repeats" not in q("aaaaa 一").issues
    sp = lambda t: one(spark, quality.spam(F.lit(""), F.col("b")), b=t)
    assert sp("http://a http://b http://c").score == 1.0 and sp("http://a http://b http://c http://d").score == pytest.approx(0.8)
    assert sp("点击这里查看 更多的详情").is_spam and not sp("点击\n查看").is_spam
    st = one(spark, quality.structure(F.col("b")), b="第一段第一段第一段第一段第一段第一段第一段第一段\n\t第二段第二段第二段第二段第二段第二段第二段第二段")
    assert st.score == pytest.approx(1.1)
    for s, want in ((0.8, "high"), (0.79, "medium"), (0.6, "medium"), (0.4, "low"), (0.39, "very_low")):
        assert one(spark, quality.label(F.lit(s)), t="") == want


def test_quality_distribution_is_complete(spark):
    df = spark.createDataFrame([("high",), ("high",), ("low",)], "quality_label string")
    assert {r.quality_label: r.n for r in quality.label_distribution(df).collect()} == {"high": 2, "medium": 0, "low": 1, "very_low": 0}


def test_dictionary_sentiment(spark):
    s = lambda t: one(spark, sentiment.dictionary_sentiment(F.col("t")), t=t)
    assert s("非常 好").label == "positive" and s("非常 好").confidence == 0.9
    assert s("不 好").label == "negative" and s("不 很 好").label == "negative" and s("不 a b 好").label == "positive"
    assert s("大幅 上涨 小幅 下跌").score == pytest.approx((1.8 - 0.8) / 2.6)
    assert s("*ST").label == "negative"
    none = s("x y")
    assert (none.label, none.confidence, none.sentiment_words_count) == ("neutral", 0.5, 0)
    df = spark.createDataFrame([(1, "不 很 好 风险"), (2, "大幅 上涨 小幅 下跌 x")], "id int, t string")
    both = sentiment.token_scores(df, "id", clean.words(F.col("t"))).join(df.select("id", sentiment.word_scores(clean.words(F.col("t"))).alias("s")), "id").collect()
    assert all(r.positive == pytest.approx(r.s.p) and r.negative == pytest.approx(r.s.n) for r in both)


def test_financial_adjustment(spark):
    f = lambda t: one(spark, sentiment.financial_adjustment(F.col("t")), t=t)
    assert f("涨停 买入 超预期") == 0.5 and f("退市 跌停") == -0.5 and f("x") == 0 and f("分红") == pytest.approx(0.1)
    a = one(spark, sentiment.adjusted(F.lit(0.9), F.lit(0.3)), t="")
    assert (a.adjusted_score, a.adjusted_label) == (1.0, "positive")


def test_classifiers(spark):
    n = one(spark, classify.news_type(F.col("t")), t="央行发布货币政策通知")
    assert n.category == "政策法规" and n.confidence == pytest.approx(5 / 6)
    assert one(spark, classify.news_type(F.col("t")), t="x").category == "其他"
    assert one(spark, classify.importance_level(F.col("t")), t="x").confidence == 0.5
    assert one(spark, classify.industry(F.col("t")), t="半导体芯片").category == "科技"
    assert one(spark, classify.news_category(F.col("t"), F.lit("")), t="ETF 行业") == "基金"
    assert one(spark, classify.announcement_type(F.col("t"), F.lit("")), t="关于停牌的年报") == "财务报告"
    assert one(spark, classify.is_important_announcement(F.col("t"), F.lit("")), t="收购资产")


def test_entities_with_offsets(spark):
    text = "贵州茅台(600519)在2024年1月2日涨5.5%"
    got = one(spark, entities.recognize(F.col("t")), t=text)
    for e in got:
        assert text[e.start : e.end] == e.text
    spans = sorted((e.start, e.end) for e in got)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert ("贵州茅台", "dictionary") in {(e.text, e.source) for e in got}
    assert len(one(spark, entities.dictionary_entities(F.col("t"), {"x": ["aa"]}), t="aaaa")) == 3
    assert one(spark, entities.recognize(F.col("t")), t="") == []
    grouped = one(spark, entities.group_by_type(entities.recognize(F.col("t"))), t=text)
    assert set(grouped) == {e.type for e in got}


def test_segmentation(spark):
    assert one(spark, segment.tokens(F.col("t")), t="A股 5G, ok_1") == ["a", "股", "5g", "ok_1"]
    assert one(spark, segment.bigrams(F.col("t")), t="新能源 car 股") == ["新能", "能源", "car", "股"]
    assert one(spark, segment.longest_match(F.col("t"), ["市盈率", "市盈", "科创板"]), t="科创板市盈率高") == ["科创板", "市盈率", "高"]
    assert one(spark, segment.segment(F.col("t"), ["b"]), t="a b 12345678901") == ["a"]
    assert segment.query_terms("央行, 降准 的 x") == ["央行", "降准"]


def test_display(spark):
    assert one(spark, display.keyword_score(F.col("a"), F.col("b"), ["x1"]), a="X1", b="x1 x1") == 1.0
    assert one(spark, display.keyword_score(F.col("a"), F.col("b"), ["aa"]), a="", b="aaaa") == pytest.approx(2 / 3)
    assert one(spark, display.bold(F.col("t"), ["Foo"]), t="a foo FOO") == "a **Foo** **Foo**"
    assert one(spark, display.mark(F.col("t"), ["foo"]), t="a Foo") == "a <mark>Foo</mark>"
    assert one(spark, display.snippet(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, display.large_number(F.lit(123456)), t="") == "12.3万"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert one(spark, display.relative_time(F.lit("2024-01-01 22:00:00").cast("timestamp"), now), t="") == "2小时前"
    assert one(spark, display.simple_sentiment(F.col("t")), t="涨 跌 好") == pytest.approx(1 / 3)
    assert one(spark, display.report_importance(F.col("t"), F.lit("ipo")), t="ipo") == pytest.approx(0.24)
    assert one(spark, display.is_spam(F.col("t"), F.lit("")), t="广告 推广 免费")
    got = one(spark, display.relevance(F.lit("央行"), F.lit("央行 降准"), "央行", ["降准"], F.lit(2.0), F.lit("2024-01-02").cast("timestamp"), now), t="")
    assert got == pytest.approx(3 + 1.5 + 1 + 0.5)
    assert display.static_suggestions("分析") == ["股票分析", "财报分析", "技术分析"]
    assert one(spark, display.budget_summary(F.col("t"), 10), t="一二三。四五六。七八九十") == "一二三。四五六。"


def test_all_entities_and_lexicon(spark):
    assert one(spark, clean.clean_text(F.col("t"), all_entities=True), t="a&mdash;b &#x41;") == "a—b A"
    assert ZH_FINANCE.name == "zh_finance"
