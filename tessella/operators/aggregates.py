"""Facets, histograms, distributions, trends and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.lexicons import ZH_FINANCE, Lexicon

FACETS = {"news_type": 10, "industry": 15, "source": 20, "sentiment_label": 5, "importance_level": 5}


def facets(df: DataFrame, sizes: dict[str, int] = FACETS) -> DataFrame:
    """facet, value, n: the commonest values of each field, ties by value.  One pass: a row is unpivoted and counted
    map-side, so the shuffle carries one row per distinct value and task."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in sizes])).alias("e")).select("e.*")
    counts = long.filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    keep = F.element_at(F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(n))]), F.col("facet"))
    return counts.withColumn("r", rank).filter(F.col("r") <= keep).select("facet", "value", "n")


def array_facet(df: DataFrame, column: str, id_col: str, size: int = 20) -> DataFrame:
    """value, n documents, for a multi-valued field."""
    e = df.select(F.col(id_col), F.explode(F.array_distinct(column)).alias("value"))
    return e.groupBy("value").agg(F.count_distinct(id_col).alias("n")).orderBy(F.desc("n"), "value").limit(size)


def date_histogram(df: DataFrame, time_col: str = "publish_time", every: str = "day") -> DataFrame:
    return df.filter(F.col(time_col).isNotNull()).groupBy(F.date_trunc(every, time_col).cast("date").alias("date")).agg(F.count("*").alias("n"))


def term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def related_topics(df: DataFrame, text: Column, keywords: list[str], lexicon: Lexicon = ZH_FINANCE, pool: int = 20, least: int = 3, size: int = 10) -> DataFrame:
    """term, n: commonest topic terms without the keywords and stop terms."""
    stop = [*keywords, *lexicon.topic_stopwords]
    t = df.select(F.explode(F.regexp_extract_all(text, F.lit(lexicon.topic_pattern), F.lit(0))).alias("term")).filter(~F.col("term").isin(stop))
    top = t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(pool)
    return top.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(size)


def date_spine(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))).alias("date"))


def daily_trend(df: DataFrame, time_col: str, sentiment: Column, importance: Column, first: Column, last: Column, rounded: bool = True) -> DataFrame:
    """date, volume, sentiment, importance, value for every day of the range; days without rows hold zeros.  The
    aggregate is joined to a spine of one row per day."""
    by = df.groupBy(F.col(time_col).cast("date").alias("date")).agg(F.count("*").alias("volume"), F.avg(sentiment).alias("sentiment"), F.avg(importance).alias("importance"))
    days = date_spine(df, first, last).join(by, "date", "left")
    v, s, i = F.coalesce("volume", F.lit(0)), F.coalesce("sentiment", F.lit(0.0)), F.coalesce("importance", F.lit(0.0))
    value = 50 + 30 * s + F.least(v / 5, F.lit(20.0)) + 10 * i if rounded else 50 + 30 * s + v / 10
    r = (lambda c, n: F.floor(c * 10**n + 0.5) / 10**n) if rounded else (lambda c, n: c)
    return days.select("date", v.alias("volume"), r(s, 3).alias("sentiment"), r(i, 3).alias("importance"), r(value, 2).alias("value"))


def active_runs(trend: DataFrame) -> DataFrame:
    """trend with active, run (id) and run_length of consecutive active days."""
    by = Window.orderBy("date")  # one row per day
    t = trend.withColumn("active", (F.col("volume") > 0) | (F.col("importance") > 0.5))
    t = t.withColumn("run", F.sum((~F.col("active")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("run_length", F.when(F.col("active"), F.sum(F.col("active").cast("int")).over(Window.partitionBy("run"))).otherwise(0))


def anomalies(trend: DataFrame) -> DataFrame:
    """trend with anomaly, anomaly_score, anomaly_reason: volume, sentiment and importance outliers in that order, whose
    reasons accumulate, then runs of at least three active days.  Fewer than three days have none."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per day
    t = active_runs(trend)
    stat = {f"{k}_{n}": F.coalesce(f(n).over(every), F.lit(0.0)) for n in ("volume", "sentiment", "importance") for k, f in (("m", F.avg), ("d", F.stddev_samp))}
    t = t.withColumns({**stat, "days": F.count("*").over(every)})
    on = F.col("days") >= 3
    v, s, i = F.col("volume"), F.col("sentiment"), F.col("importance")
    loud = on & (v > F.col("m_volume") + 2 * F.col("d_volume")) & (v > 2 * F.col("m_volume"))
    moody = on & (F.abs(s - F.col("m_sentiment")) > 2 * F.col("d_sentiment")) & (F.abs(s) > 0.5)
    dense = on & (i > F.col("m_importance") + F.col("d_importance")) & (i > 0.7)
    long = on & (F.col("run_length") >= 3)
    score = (
        F.when(loud, F.least(F.lit(1.0), (v - F.col("m_volume")) / F.greatest(F.col("m_volume"), F.lit(1.0))))
        .when(moody, F.least(F.lit(1.0), F.abs(s - F.col("m_sentiment")) / F.greatest(F.col("d_sentiment"), F.lit(0.1))))
        .when(dense, i).when(long, F.lit(0.6)).otherwise(F.lit(0.0))
    )
    reason = F.concat_ws(
        "；", F.when(loud, F.concat(F.lit("volume:"), v.cast("string"))), F.when(moody, F.when(s > 0.5, F.lit("sentiment:high")).otherwise(F.lit("sentiment:low"))), F.when(dense, F.lit("importance")),
        F.when(long & ~loud & ~moody & ~dense, F.concat(F.lit("active days:"), F.col("run_length").cast("string"))),
    )
    return t.select(*trend.columns, (loud | moody | dense | long).alias("anomaly"), score.alias("anomaly_score"), reason.alias("anomaly_reason"))


def document_frequency(df: DataFrame, terms: list[str], title: Column, content: Column) -> DataFrame:
    """term, n documents, for a list of terms in one pass."""
    t, c = F.lower(title), F.lower(content)
    hit = F.array(*[F.struct(F.lit(x).alias("term"), (t.contains(x.lower()) | c.contains(x.lower())).cast("int").alias("hit")) for x in terms])
    return df.select(F.explode(hit).alias("e")).groupBy("e.term").agg(F.sum("e.hit").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n, percentage; the window runs over one row per value."""
    by = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return by.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def dominant(df: DataFrame, column: str) -> DataFrame:
    """The commonest value, ties to the smallest."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def crawl_stats(df: DataFrame) -> DataFrame:
    """type, source, category, n, avg_length by type, by source, by category and in total, in one pass."""
    sized = F.avg(F.when(F.col("content_length") > 0, F.col("content_length")))
    return df.groupingSets([["type"], ["source"], ["category"], []], "type", "source", "category").agg(F.count("*").alias("n"), sized.alias("avg_length"))


def timeline(df: DataFrame, time_col: str, score: str) -> DataFrame:
    return df.groupBy(F.col(time_col).cast("date").alias("date")).agg(F.count("*").alias("n"), F.avg(score).alias("avg_sentiment"))


def topic_sentiment(df: DataFrame) -> DataFrame:
    """positive, negative, neutral shares and mean confidence."""
    share = lambda k: F.avg((F.col("label") == k).cast("double")).alias(k)
    return df.agg(share("positive"), share("negative"), share("neutral"), F.avg("confidence").alias("confidence"))


def mean_vector(vectors: DataFrame, column: str, mode: str = "mean") -> DataFrame:
    """One row with the element-wise mean, max or 1/(i+1)-weighted mean (column i orders) of a few query vectors."""
    e = vectors.select("i", F.posexplode(column).alias("pos", "x"))
    w = 1.0 / (F.col("i") + 1)
    agg = {"mean": F.avg("x"), "max": F.max("x"), "weighted": F.sum(F.col("x") * w) / F.sum(w)}[mode]
    by = e.groupBy("pos").agg(agg.cast("double").alias("x"))
    return by.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(column))


def health(df: DataFrame) -> DataFrame:
    """status: no unhealthy service healthy, under half degraded, else unhealthy; integer mean response."""
    bad, n = F.count_if(F.col("status") != "healthy"), F.count("*")
    return df.agg(F.when(bad == 0, "healthy").when(bad < F.floor(n / 2), "degraded").otherwise("unhealthy").alias("status"), F.floor(F.avg("response_ms")).alias("avg_response_ms"), n.alias("services"))


def log_stats(df: DataFrame) -> DataFrame:
    """service (null: all), lines, errors, warnings."""
    line = F.lower("message")
    return df.rollup("service").agg(F.count("*").alias("lines"), F.count_if(line.rlike("error|exception|failed|fatal")).alias("errors"), F.count_if(line.rlike("warn")).alias("warnings"))


def last_errors(df: DataFrame, k: int = 5) -> DataFrame:
    return df.filter(F.lower("message").rlike("error|exception|failed|fatal")).orderBy(F.desc("timestamp"), "service", "message").limit(k)


def request_metrics(df: DataFrame) -> DataFrame:
    """method, endpoint, requests, errors, mean and percentile latency over a request log."""
    return df.groupBy("method", "endpoint").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("ms").alias("avg_ms"), F.percentile_approx("ms", [0.5, 0.95, 0.99]).alias("percentiles"),
    )


def run_totals(df: DataFrame, by: str = "source_id") -> DataFrame:
    """Per source: runs, documents, errors, last and next time over a run log."""
    return df.groupBy(by).agg(F.count("*").alias("runs"), F.sum("documents").alias("documents"), F.sum("errors").alias("errors"), F.max("finished").alias("last_sync"), F.max("next_sync").alias("next_sync"))
