"""The intelligence report of a topic: collect, rank, trend, anomalies, insights, related topics, graph, summary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify, display, sentiment
from tessella.lexicons import ZH_FINANCE, Lexicon
from tessella.operators import aggregates, filters, graph, tables, vectors
from tessella.plans.search import score_keyword


@dataclass(frozen=True)
class ReportSpec:
    topic: str
    keywords: tuple[str, ...] = ()
    days: int = 30
    sources: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.topic:
            raise ValueError("topic must not be empty")
        if not 1 <= self.days <= 365:
            raise ValueError("days must be 1 to 365")


@dataclass
class Report:
    documents: DataFrame
    sentiment_stats: DataFrame
    class_stats: DataFrame
    trend: DataFrame
    insights: DataFrame
    related: list[str]
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    summary: str


def collect_documents(df: DataFrame, spec: ReportSpec, now: datetime, id_col: str = "id", time_col: str = "publish_time", lexicon: Lexicon = ZH_FINANCE, cap: int = 200, query_vector: list[float] | None = None, vector_col: str = "embedding") -> DataFrame:
    """The `cap` most relevant documents of the topic inside the time range and sources, with relevance: hits by words
    and, given a query vector, the `cap` nearest by vector; a document that both find keeps the better score."""
    where = F.col(time_col).between(F.lit(now - timedelta(days=spec.days)), F.lit(now))
    if spec.sources:
        where = where & F.col("source").isin(list(spec.sources))
    base = df.filter(where)
    hits = score_keyword(df, " ".join([spec.topic, *spec.keywords]), id_col, lexicon, where).select(id_col, display.normalized_score(F.col("score")).alias("_score"))
    if query_vector is not None:
        near = vectors.top_k(base, id_col, vector_col, query_vector, cap, cap=cap).select(id_col, F.col("score").alias("_score"))
        hits = hits.unionByName(near).groupBy(id_col).agg(F.max("_score").alias("_score"))
    found = base.join(hits, id_col)
    found = tables.latest(found.withColumn("_h", F.md5(F.concat("content", "title"))), "_h", F.asc(id_col)).drop("_h")
    found = found.filter(filters.report_quality(F.col("title"), F.col("content"), lexicon))
    r = display.relevance(F.col("title"), F.col("content"), spec.topic, list(spec.keywords), F.col("_score"), F.col(time_col), F.lit(now))
    return found.withColumn("relevance", r).drop("_score").orderBy(F.desc(F.round("relevance", 9)), id_col).limit(cap)


def topic_trend(docs: DataFrame, first: Column, last: Column, time_col: str = "publish_time", lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    text = F.concat("title", F.lit(" "), "content")
    return aggregates.daily_trend(docs, time_col, display.simple_sentiment(text, lexicon), display.report_importance(text, F.col("title"), lexicon), first, last)


def insights(stats: DataFrame, classes: DataFrame, n_docs: int, topic: str) -> DataFrame:
    """title, description, confidence, type: volume, mood and dominant type, each only where its threshold is met.
    stats and classes have a few rows."""
    spark = stats.sparkSession
    rows = []
    if n_docs > 50:
        rows.append(("high attention", f"{topic}: {n_docs} documents", 0.9, "volume"))
    elif n_docs < 10:
        rows.append(("little information", f"{topic}: {n_docs} documents", 0.7, "volume"))
    share = {r["label"]: r["percentage"] / 100 for r in stats.collect()}
    if share.get("positive", 0) > 0.6:
        rows.append(("positive mood", f"{topic}: {share['positive']:.1%} positive", 0.8, "sentiment"))
    elif share.get("negative", 0) > 0.6:
        rows.append(("cautious mood", f"{topic}: {share['negative']:.1%} negative", 0.8, "sentiment"))
    top = classes.filter("kind = 'news_type'").orderBy(F.desc("n"), "category").limit(1).collect()
    if top and top[0]["percentage"] > 40:
        rows.append((f"{top[0]['category']} dominates", f"{topic}: {top[0]['percentage'] / 100:.1%} {top[0]['category']}", 0.7, "classification"))
    return spark.createDataFrame(rows, "title string, description string, confidence double, type string")


def summary_text(topic: str, days: int, n_docs: int, avg_sentiment: float | None, main_type: str | None) -> str:
    parts = [f"{topic}: {n_docs} documents in {days} days."]
    if avg_sentiment is not None:
        mood = "positive" if avg_sentiment > 0.2 else "negative" if avg_sentiment < -0.2 else "neutral"
        parts.append(f"The overall mood is {mood}.")
    parts.append(f"Most are {main_type}." if main_type else "Types vary.")
    if avg_sentiment is not None:
        parts.append("Keep following it." if avg_sentiment > 0.3 else "Watch the risks." if avg_sentiment < -0.3 else "Weigh several factors.")
    return " ".join(parts)


def generate(df: DataFrame, spec: ReportSpec, now: datetime, id_col: str = "id", time_col: str = "publish_time", lexicon: Lexicon = ZH_FINANCE, head: int = 100, query_vector: list[float] | None = None) -> Report:
    """All parts over one collected set of at most 200 documents."""
    docs = collect_documents(df, spec, now, id_col, time_col, lexicon, query_vector=query_vector).cache()
    text = F.concat("title", F.lit(" "), "content")
    n = docs.count()
    first = docs.orderBy(F.desc("relevance"), id_col).limit(head)
    labelled = classify.classify(first, text, lexicon).withColumn("_s", sentiment.dictionary_sentiment(text, lexicon))
    stats = sentiment.sentiment_stats(labelled.select("_s.label", "_s.score", "_s.confidence"))
    classes = classify.class_distribution(labelled)
    related = [r["term"] for r in aggregates.related_topics(docs, F.lower(text), list(spec.keywords), lexicon).collect()]  # at most 10
    nodes = graph.graph_nodes(docs, spec.topic, list(spec.keywords), related, F.col("title"), F.col("content"))
    edges = graph.graph_edges(docs, spec.topic, list(spec.keywords), related, text)
    avg = stats.select("avg_score").first()
    main = classes.filter("kind = 'news_type'").orderBy(F.desc("n"), "category").select("category").first()
    start, end = F.lit(now - timedelta(days=spec.days)).cast("date"), F.lit(now).cast("date")
    return Report(
        docs, stats, classes, aggregates.anomalies(topic_trend(docs, start, end, time_col, lexicon)), insights(stats, classes, n, spec.topic), related, nodes, edges, graph.graph_clusters(nodes),
        summary_text(spec.topic, spec.days, n, avg[0] if avg else None, main[0] if main else None),
    )


def export_text(report: Report, topic: str) -> str:
    """A plain text form of the report's small parts."""
    lines = [topic, "", report.summary, "", "Insights:"]
    lines += [f"- {r['title']} ({r['confidence']:.0%}): {r['description']}" for r in report.insights.collect()]
    lines += ["", "Related: " + ", ".join(report.related), "", "Trend:"]
    lines += [f"{r['date']} volume {r['volume']} value {r['value']:.2f}" + (" anomaly" if r["anomaly"] else "") for r in report.trend.orderBy("date").collect()]
    return "\n".join(lines)


def list_reports(reports: DataFrame, query: str = "", size: int = 10, offset: int = 0) -> DataFrame:
    """Saved reports (report_id, topic, summary, status, created), newest first."""
    df = reports.filter(filters.report_matches(query)) if query else reports
    return tables.page(df, [F.desc("created"), F.asc("report_id")], size, offset)


def monitor(df: DataFrame, specs: list[ReportSpec], now: datetime, threshold: float = 0.8, id_col: str = "id", lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """topic, documents, strongest, alert for saved specifications over one micro-batch; for use in foreachBatch."""
    out = None
    for s in specs:
        d = collect_documents(df, s, now, id_col, lexicon=lexicon)
        i = display.report_importance(F.concat("title", F.lit(" "), "content"), F.col("title"), lexicon)
        row = d.agg(F.count("*").alias("documents"), F.max(i).alias("strongest")).select(F.lit(s.topic).alias("topic"), "documents", "strongest", (F.coalesce("strongest", F.lit(0.0)) >= threshold).alias("alert"))
        out = row if out is None else out.unionByName(row)
    return out
