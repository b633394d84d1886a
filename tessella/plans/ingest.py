"""The ingest pipeline: clean, extract, deduplicate, assess, route."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import classify, clean, entities, features, quality, sentiment
from tessella.functions.segment import let
from tessella.lexicons import ZH_FINANCE, Lexicon
from tessella.operators import aggregates, dedup, filters
from tessella.schemas import RAW_DOCUMENTS, conform
from tessella.session import staged


@dataclass
class Options:
    lexicon: Lexicon = ZH_FINANCE
    keep_lines: bool = True
    near_duplicates: bool = True
    threshold: float = 0.85
    quality_threshold: float = 0.6
    filter_quality: bool = True
    nlp_sentiment: bool = True
    nlp_entities: bool = True
    nlp_classification: bool = True
    nlp_keywords: bool = True
    id_col: str = "id"
    extra_stages: list[Callable[[DataFrame], DataFrame] | str] = field(default_factory=list)


@dataclass
class Result:
    final: DataFrame
    duplicates: DataFrame
    low_quality: DataFrame
    assessed: DataFrame
    marked: DataFrame

    def counts(self) -> dict[str, int]:
        """One job over the assessed rows and one over the duplicates."""
        q = self.assessed.agg(F.count("*").alias("n"), F.count_if(F.col("quality.is_high_quality")).alias("high")).first()
        d = self.duplicates.count()
        return {"processed": q["n"] + d, "duplicates": d, "high_quality": q["high"], "low_quality": q["n"] - q["high"]}


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_stage(name: str, stage: Callable[[DataFrame], DataFrame]) -> None:
    """A user stage by name, for Options.extra_stages."""
    STAGES[name] = stage


def process(docs: DataFrame, options: Options | None = None) -> Result:
    """Every row ends in exactly one of final, duplicates and low_quality (with filter_quality)."""
    o = options or Options()
    # staged, since each feature would hold the expression of the cleaned text
    cleaned = staged(clean.clean_documents(docs, o.lexicon, o.keep_lines), "cleaned")
    rich = features.extract_features(cleaned, o.lexicon)
    for stage in o.extra_stages:
        rich = (STAGES[stage] if isinstance(stage, str) else stage)(rich)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    if o.near_duplicates:
        rich = staged(rich, "rich")  # cleaned and extracted once: the comparison and every result read the rows several times
        marked = dedup.deduplicate(rich, o.id_col, text, "content_hash", o.threshold)
    else:
        marked = dedup.exact(rich, "content_hash", o.id_col).withColumn("dup_kind", F.when(F.col("dup_of").isNotNull(), "exact"))
    unique = marked.filter("dup_kind is null").drop("dup_kind", "dup_of")
    assessed = quality.assess(unique, o.lexicon, o.quality_threshold)
    final = quality.high_quality(assessed) if o.filter_quality else assessed
    return Result(final, marked.filter("dup_kind is not null"), quality.low_quality(assessed), assessed, marked)


def nlp(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """docs with sentiment_analysis, recognized_entities, grouped_entities, classification structs and keywords."""
    o = options or Options()
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    text = F.concat(title, F.lit(" "), content)
    out = docs
    if o.nlp_keywords:
        out = out.withColumn("extracted_keywords", features.keywords_array(text, 20, o.lexicon))
    if o.nlp_entities:
        found = let(entities.recognize(text), lambda e: F.struct(e.alias("e"), entities.group_by_type(e).alias("g")))  # searched once a row
        out = out.withColumn("_found", found).withColumns({"recognized_entities": F.col("_found.e"), "grouped_entities": F.col("_found.g")}).drop("_found")
    if o.nlp_sentiment:
        s = {"s_title": sentiment.dictionary_sentiment(title, o.lexicon), "s_content": sentiment.dictionary_sentiment(content, o.lexicon), "s_shift": sentiment.financial_adjustment(text, o.lexicon)}
        out = out.withColumns(s)
        overall = F.when(F.col("s_content.sentiment_words_count") > 0, 0.3 * F.col("s_title.score") + 0.7 * F.col("s_content.score")).otherwise(F.col("s_title.score"))
        out = out.withColumn("sentiment_analysis", F.struct(F.col("s_title").alias("title"), F.col("s_content").alias("content"), sentiment.adjusted(overall, F.col("s_shift")).alias("financial"), overall.alias("overall")))
        out = out.drop(*s)
    if o.nlp_classification:
        out = classify.classify(out, text, o.lexicon)
    return out


def nlp_summary(docs: DataFrame) -> DataFrame:
    """documents, average entities and keywords, over nlp() rows."""
    return docs.agg(F.count("*").alias("documents"), F.avg(F.size("recognized_entities")).alias("avg_entities"), F.avg(F.size("extracted_keywords")).alias("avg_keywords"), F.avg("sentiment_analysis.overall").alias("avg_sentiment"))


def nlp_distributions(docs: DataFrame) -> DataFrame:
    """kind, value, n, percentage: sentiment labels, news types, industries and importance levels, in one pass."""
    kinds = {"sentiment": "sentiment_analysis.financial.adjusted_label", "news_type": "news_type.category", "industry": "industry.category", "importance_level": "importance_level.category"}
    long = docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])).alias("e")).select("e.*")
    counts = long.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("kind")))  # one row per value


def feature_summary(docs: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.select(
        id_col, F.size("extracted_keywords").alias("keywords"), F.size("recognized_entities").alias("entities"), F.map_keys("grouped_entities").alias("entity_types"),
        F.col("sentiment_analysis.financial.adjusted_label").alias("sentiment"), F.col("news_type.category").alias("news_type"), F.col("industry.category").alias("industry"),
    )


def ingest_json(spark: SparkSession, path: str) -> DataFrame:
    """Posted documents of a folder; rows without an id, title, content or URL are dropped."""
    df = conform(spark.read.schema(RAW_DOCUMENTS).json(path), RAW_DOCUMENTS)
    return df.filter(F.col("id").isNotNull() & filters.valid_item(min_content=1))


def report(result: Result, samples: int = 3) -> str:
    """Counts, quality labels and samples as JSON."""
    rows = {name: [r.asDict() for r in df.select("id", "title", "url").limit(samples).collect()] for name, df in (("final", result.final), ("duplicates", result.duplicates), ("low_quality", result.low_quality))}
    labels = {r["value"]: r["n"] for r in aggregates.distribution(result.assessed, "quality_label").collect()}
    return json.dumps({"statistics": result.counts(), "labels": labels, "samples": rows}, ensure_ascii=False, default=str)


def observed(df: DataFrame, name: str = "pipeline") -> DataFrame:
    """df whose run also reports rows and characters as an observed metric, without another pass."""
    return df.observe(name, F.count("*").alias("rows"), F.sum(F.length("content")).alias("characters"))
