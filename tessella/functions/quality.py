"""Rule-based quality: five checks, a weighted score and a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.features import count_words
from tessella.functions.segment import let
from tessella.lexicons import QUALITY_WEIGHTS, ZH_FINANCE, Lexicon

MIN_WORDS, MAX_WORDS, HIGH = 20, 10_000, 0.6
LABELS = ("high", "medium", "low", "very_low")


def _minus(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(-amount)).otherwise(F.lit(0.0))


def _words(text: Column) -> Column:
    """How many words; as an array of them where the words themselves count, use clean.words."""
    return F.regexp_count(text, F.lit("\\S+"))


def _scored(checks: list[tuple[Column, str, float]], more: dict[str, Column], body) -> Column:
    """body(score, issues, more) with each check and each of more evaluated once a row: without this the planner copies a
    check into the score, the issues and whatever is made of them."""
    once = F.struct(F.array(*[F.coalesce(c, F.lit(False)) for c, _, _ in checks]).alias("flags"), *[c.alias(k) for k, c in more.items()])

    def parts(v: Column) -> Column:
        flag = [F.get(v["flags"], i) for i in range(len(checks))]
        score = sum((_minus(f, a) for f, (_, _, a) in zip(flag, checks, strict=True)), F.lit(1.0))
        issues = F.array_compact(F.array(*[F.when(f, F.lit(name)) for f, (_, name, _) in zip(flag, checks, strict=True)]))
        return body(score, issues, {k: v[k] for k in more})

    return let(once, parts)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def completeness(title: Column, content: Column, url: Column, source: Column, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> Column:
    t = F.length(title)

    def checked(v: Column) -> Column:
        n = v["n"]
        checks = [(_blank(title), "missing:title", 0.2), (_blank(content), "missing:content", 0.2), (_blank(url), "missing:url", 0.2), (_blank(source), "missing:source", 0.2),
                  (n < min_words, "content:short", 0.3), (n > max_words, "content:long", 0.1), (t < 5, "title:short", 0.2), (t > 200, "title:long", 0.1)]
        return _scored(checks, {"n": n}, lambda score, issues, m: F.struct(F.greatest(F.lit(0.0), score).alias("score"), issues.alias("issues"), m["n"].alias("word_count")))

    return let(F.struct(_words(content).alias("n")), checked)


def content_quality(title: Column, content: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    full = F.concat(title, F.lit(" "), content)
    found = F.regexp_extract_all(full, F.lit("\\S+"), F.lit(0))
    sizes = let(found, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    once = F.struct(sizes.alias("w"), F.size(F.filter(F.split(content, lexicon.sentence_end), lambda s: F.length(F.trim(s)) > 5)).alias("sentences"))

    def checked(v: Column) -> Column:
        n, sentences = v["w"]["n"], v["sentences"]
        diversity = F.when(n > 0, v["w"]["distinct"] / n).otherwise(F.lit(0.0))
        # fixed values: the low-quality patterns
        checks = [(full.rlike("[!！]{3,}|[?？]{3,}|[.。]{5,}"), "punctuation", 0.15), (full.rlike("[A-Z]{10,}"), "capitals", 0.15), (full.rlike("(.)\\1{5,}"), "repeats", 0.15),
                  ((n > 0) & (F.regexp_count(full, F.lit("[0-9]+")) / F.nullif(n, F.lit(0)) > 0.3), "numbers", 0.2), ((n > 10) & (diversity < 0.3), "monotone", 0.2), (sentences < 2, "sentences", 0.2)]

        def body(score: Column, issues: Column, m: dict[str, Column]) -> Column:
            return F.struct(
                F.when(m["empty"], F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score)).alias("score"), F.when(m["empty"], F.array(F.lit("empty"))).otherwise(issues).alias("issues"),
                m["diversity"].alias("diversity_ratio"), m["sentences"].alias("sentence_count"),
            )

        return _scored(checks, {"empty": F.trim(full) == "", "diversity": diversity, "sentences": sentences}, body)

    return let(once, checked)


def information_value(title: Column, content: Column, n_entities: Column, has_time: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    once = F.struct(
        let(F.lower(F.concat(title, F.lit(" "), content)), lambda low: count_words(low, lexicon.value_phrases)).alias("hits"),
        F.regexp_count(content, F.lit("[0-9]+\\.?[0-9]*")).alias("numbers"), n_entities.alias("entities"), has_time.alias("timed"),
    )

    def body(v: Column) -> Column:
        score = 0.5 + F.least(F.lit(0.3), v["hits"] * 0.1) + F.least(F.lit(0.2), v["entities"] * 0.02) + F.when(v["numbers"] >= 3, 0.1).otherwise(0.0) + F.when(v["timed"], 0.1).otherwise(0.0)
        return F.struct(F.least(F.lit(1.0), score).alias("score"), v["entities"].alias("entity_count"), v["numbers"].alias("number_count"), v["hits"].alias("value_phrases"))

    return let(once, body)


def spam(title: Column, content: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    full = F.concat(title, F.lit(" "), content)
    checks = [(full.rlike("(?i)" + p), p, 0.3) for p in lexicon.spam_patterns]
    checks += [(F.regexp_count(full, F.lit("https?://\\S+")) > 3, "links", 0.2), (full.rlike(lexicon.contact_pattern), "contact", 0.3)]
    return _scored(checks, {}, lambda raw, issues, m: F.struct(F.greatest(F.lit(0.0), raw).alias("score"), (raw < 0.5).alias("is_spam")))


def structure(content: Column, lexicon: Lexicon = ZH_FINANCE) -> Column:
    """May reach 1.1: the bonus for formatted content is not capped."""
    once = F.struct(
        F.size(F.filter(F.split(content, "\n"), lambda p: F.length(F.trim(p)) > 20)).alias("paragraphs"), _words(content).alias("n"), F.regexp_count(content, F.lit(lexicon.punctuation)).alias("marks"),
        (content.contains("\t") | content.contains("    ")).alias("formatted"), (F.length(content) == 0).alias("empty"),
    )

    def body(v: Column) -> Column:
        score = 1.0 + _minus(v["paragraphs"] < 2, 0.2) + _minus((v["n"] > 50) & (v["marks"] / F.greatest(v["n"], F.lit(1)) < 0.05), 0.2) + F.when(v["formatted"], 0.1).otherwise(0.0)
        return F.struct(F.when(v["empty"], F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score)).alias("score"), v["paragraphs"].alias("paragraph_count"))

    return let(once, body)


def overall(parts: dict[str, Column]) -> Column:
    return sum((parts[k] * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0)) / sum(QUALITY_WEIGHTS.values())


def label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("very_low")


def assess(df: DataFrame, lexicon: Lexicon = ZH_FINANCE, threshold: float = HIGH) -> DataFrame:
    """df with the struct quality and quality_label.  Missing title, content, url, source, entities or publish_time
    count as empty."""
    have = set(df.columns)
    get = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    title, content = get("title"), get("content")
    n_entities = F.coalesce(F.size("entities"), F.lit(0)) if "entities" in have else F.lit(0)
    has_time = F.col("publish_time").isNotNull() if "publish_time" in have else F.lit(False)
    out = df.withColumns({
        "_q1": completeness(title, content, get("url"), get("source")), "_q2": content_quality(title, content, lexicon),
        "_q3": information_value(title, content, n_entities, has_time, lexicon), "_q4": spam(title, content, lexicon), "_q5": structure(content, lexicon),
    })
    total = overall({"completeness": F.col("_q1.score"), "content_quality": F.col("_q2.score"), "information_value": F.col("_q3.score"), "spam_detection": F.col("_q4.score"), "structure_quality": F.col("_q5.score")})
    quality = F.struct(
        total.alias("overall"), F.col("_q1.score").alias("completeness"), F.col("_q2.score").alias("content_quality"), F.col("_q3.score").alias("information_value"),
        F.col("_q4.score").alias("spam"), F.col("_q5.score").alias("structure"), F.col("_q4.is_spam").alias("is_spam"), (total >= threshold).alias("is_high_quality"),
        F.concat(F.col("_q1.issues"), F.col("_q2.issues")).alias("issues"),
    )
    return out.withColumn("quality", quality).withColumn("quality_label", label(F.col("quality.overall"))).drop("_q1", "_q2", "_q3", "_q4", "_q5")


def high_quality(df: DataFrame) -> DataFrame:
    return df.filter("quality.is_high_quality")


def low_quality(df: DataFrame) -> DataFrame:
    return df.filter("not quality.is_high_quality")


def label_distribution(df: DataFrame) -> DataFrame:
    """Four rows, zero filled."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("quality_label"))
    counts = df.groupBy("quality_label").agg(F.count("*").alias("n"))
    return names.join(counts, "quality_label", "left").select("quality_label", F.coalesce("n", F.lit(0)).alias("n"))
