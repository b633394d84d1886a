"""Dictionary sentiment over tokens, with intensity and negation, and the financial adjustment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.clean import words
from tessella.functions.segment import let
from tessella.lexicons import ZH_FINANCE, Lexicon


def word_scores(tokens: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    """struct<positive, negative>: each lexicon word counts its intensity (from the word before it) for its side, or
    for the other side if one of the two words before it negates."""
    level = F.create_map(*[F.lit(x) for kv in lexicon.intensity.items() for x in kv])
    before = lambda i, n: F.get(tokens, i - n)

    def one(w: Column, i: Column) -> Column:
        weight = F.coalesce(F.try_element_at(level, F.coalesce(before(i, 1), F.lit(""))), F.lit(1.0))
        negated = F.coalesce(before(i, 1).isin(lexicon.negations), F.lit(False)) | F.coalesce(before(i, 2).isin(lexicon.negations), F.lit(False))
        side = F.when(w.isin(lexicon.positive), 1).when(w.isin(lexicon.negative), -1).otherwise(0)
        side = F.when(negated, -side).otherwise(side)
        return F.struct(F.when(side > 0, weight).otherwise(0.0).alias("p"), F.when(side < 0, weight).otherwise(0.0).alias("n"))

    total = F.aggregate(F.transform(tokens, one), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["p"] + x["p"]).alias("p"), (a["n"] + x["n"]).alias("n")))
    return total


def token_scores(df: DataFrame, id_col: str, tokens: Column, lexicon: Lexicon = ZH_FINANCE) -> DataFrame:
    """id, positive, negative by window functions over exploded tokens: the form for very long texts."""
    t = df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "w"))
    by = Window.partitionBy(id_col).orderBy("pos")
    level = F.create_map(*[F.lit(x) for kv in lexicon.intensity.items() for x in kv])
    t = t.withColumns({"w1": F.lag("w", 1).over(by), "w2": F.lag("w", 2).over(by)})
    weight = F.coalesce(F.try_element_at(level, F.coalesce("w1", F.lit(""))), F.lit(1.0))
    negated = F.coalesce(F.col("w1").isin(lexicon.negations), F.lit(False)) | F.coalesce(F.col("w2").isin(lexicon.negations), F.lit(False))
    side = F.when(F.col("w").isin(lexicon.positive), 1).when(F.col("w").isin(lexicon.negative), -1).otherwise(0)
    t = t.withColumn("side", F.when(negated, -side).otherwise(side)).withColumn("weight", weight)
    return t.groupBy(id_col).agg(F.sum(F.when(F.col("side") > 0, F.col("weight")).otherwise(0.0)).alias("positive"), F.sum(F.when(F.col("side") < 0, F.col("weight")).otherwise(0.0)).alias("negative"))


def verdict(positive: Column, negative: Column) -> Column:
    """struct<label, score, confidence, probabilities, sentiment_words_count>."""
    total = positive + negative
    net = F.when(total > 0, (positive - negative) / total).otherwise(F.lit(0.0))
    label = F.when(net > 0.2, "positive").when(net < -0.2, "negative").otherwise("neutral")
    confidence = F.when(total == 0, F.lit(0.5)).when(F.abs(net) > 0.2, F.least(F.lit(0.9), F.abs(net) + 0.5)).otherwise(F.lit(0.6))
    rest = (1 - confidence) / 2
    p = lambda name: F.when(label == name, confidence).otherwise(rest).alias(name)
    return F.struct(
        label.alias("label"), net.alias("score"), confidence.alias("confidence"), F.struct(p("positive"), p("negative"), p("neutral")).alias("probabilities"),
        F.lit("dictionary").alias("method"), F.floor(total).cast("int").alias("sentiment_words_count"),
    )


def dictionary_sentiment(text: Column, lexicon: Lexicon = ZH_FINANCE, segmenter=words) -> Column:
    """For space-separated or segmented text; an unsegmented text needs a segmenter."""
    return let(segmenter(text), lambda t: let(word_scores(t, lexicon), lambda s: verdict(s["p"], s["n"])))


def financial_adjustment(text: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    total = sum((F.when(text.rlike(p), F.lit(v)).otherwise(F.lit(0.0)) for p, v in lexicon.shifts), F.lit(0.0))
    return F.greatest(F.lit(-0.5), F.least(F.lit(0.5), total))


def adjusted(score: Column, shift: Column) -> Column:
    """struct<adjusted_score, adjusted_label>."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score + shift))
    return F.struct(s.alias("adjusted_score"), F.when(s > 0.2, "positive").when(s < -0.2, "negative").otherwise("neutral").alias("adjusted_label"))


def model_sentiment(text: Column, predict, classes: tuple[str, ...] = ("negative", "neutral", "positive")) -> Column:
    """Pluggable: predict(list of texts) gives a row of class probabilities for each.  Loaded once per worker."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, r)) for r in predict(s.fillna("").tolist())])

    p = run(text)
    return F.struct(p.alias("probabilities"), F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int")).alias("label"))


def sentiment_stats(df: DataFrame, label: str = "label", score: str = "score", confidence: str = "confidence") -> DataFrame:
    """label, n, percentage, avg_score, avg_confidence (over all rows in the last two).  One aggregation; the windows
    run over one row per label."""
    by = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(confidence).alias("c"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(everything)
    return by.select("label", "n", (F.col("n") * 100.0 / total).alias("percentage"), (F.sum("s").over(everything) / total).alias("avg_score"), (F.sum("c").over(everything) / total).alias("avg_confidence"))
