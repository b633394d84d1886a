"""Rule-based classifiers by keyword and pattern scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.features import any_word, count_words
from tessella.lexicons import (
    ANNOUNCEMENT_DEFAULT,
    ANNOUNCEMENT_RULES,
    IMPORTANT_ANNOUNCEMENT,
    NEWS_CATEGORY_DEFAULT,
    NEWS_CATEGORY_RULES,
    ZH_FINANCE,
    Lexicon,
)


def by_rules(text: Column, rules: dict, default: str, default_confidence: float) -> Column:
    """struct<category, confidence, scores>: +1 a keyword, +2 a pattern; the first best class wins."""
    scores = []
    for rule in rules.values():
        keywords, patterns = rule if isinstance(rule, tuple) else (rule, [])
        s = count_words(text, keywords).cast("double")
        for p in patterns:
            s = s + F.when(text.rlike(p), 2.0).otherwise(0.0)
        scores.append(s)
    all_scores = F.array(*scores)
    top = F.array_max(all_scores)
    total = F.aggregate(all_scores, F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*[F.lit(k) for k in rules]), F.array_position(all_scores, top).cast("int"))
    return F.struct(
        F.when(top > 0, name).otherwise(F.lit(default)).alias("category"),
        F.when(top > 0, F.least(F.lit(0.95), top / F.greatest(total, F.lit(1.0)))).otherwise(F.lit(default_confidence)).alias("confidence"),
        all_scores.alias("scores"),
    )


def news_type(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    return by_rules(text, lexicon.news_types, lexicon.news_type_default, 0.3)


def industry(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    return by_rules(text, lexicon.industries, lexicon.industry_default, 0.3)


def importance_level(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    return by_rules(text, lexicon.importance, "medium", 0.5)


def investment_relevance(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    return by_rules(text, lexicon.relevance, "medium", 0.5)


CLASSIFIERS = {"news_type": news_type, "industry": industry, "importance_level": importance_level, "investment_relevance": investment_relevance}


def classify(df: DataFrame, text: Column, lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """df with a struct per classifier and overall_confidence, their mean."""
    out = df.withColumns({k: f(text, lexicon) for k, f in CLASSIFIERS.items()})
    return out.withColumn("overall_confidence", sum((F.col(f"{k}.confidence") for k in CLASSIFIERS), F.lit(0.0)) / len(CLASSIFIERS))


def class_distribution(df: DataFrame) -> DataFrame:
    """kind, category, n, percentage for all classifiers in one pass over classified rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.category").alias("category")) for k in CLASSIFIERS])).alias("e")).select("e.*")
    by = long.groupBy("kind", "category").agg(F.count("*").alias("n"))
    return by.withColumn("percentage", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("kind")))


def top_categories(df: DataFrame, kind: str = "news_type", k: int = 5) -> DataFrame:
    return df.groupBy(F.col(f"{kind}.category").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule one of whose words occurs in the lower-cased text."""
    low = F.lower(text)
    out = None
    for name, words in rules:
        out = F.when(any_word(low, words), name) if out is None else out.when(any_word(low, words), name)
    return F.lit(default) if out is None else out.otherwise(default)


def news_category(title: Column, content: Column) -> Column:
    return first_rule(F.concat(title, F.lit(" "), content), NEWS_CATEGORY_RULES, NEWS_CATEGORY_DEFAULT)


def announcement_type(title: Column, content: Column) -> Column:
    return first_rule(F.concat(title, F.lit(" "), content), ANNOUNCEMENT_RULES, ANNOUNCEMENT_DEFAULT)


def is_important_announcement(title: Column, content: Column) -> Column:
    return any_word(F.lower(F.concat(title, F.lit(" "), content)), IMPORTANT_ANNOUNCEMENT)


def train_text_classifier(labelled: DataFrame, tokens_col: str = "tokens", label_col: str = "label", features: int = 4096):
    """TF-IDF and multinomial naive Bayes as one pyspark.ml pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF

    tf = HashingTF(inputCol=tokens_col, outputCol="_tf", numFeatures=features)
    idf = IDF(inputCol="_tf", outputCol="_tfidf")
    bayes = NaiveBayes(featuresCol="_tfidf", labelCol=label_col, modelType="multinomial")
    return Pipeline(stages=[tf, idf, bayes]).fit(labelled.select(tokens_col, F.col(label_col).cast("double").alias(label_col)))
