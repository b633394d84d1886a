"""The driver's queries of this folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, passages, pii, quality_cnn, quality_rules, token_counts
from tessella.llm._shared import table

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("src")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.quality_scores(docs, quality_cnn.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit_field(docs, table(spark, sf_dir, "labels")))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), pii.fit_pii(spark))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS lost FROM k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM o GROUP BY doc_id""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM t)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op5_mixing": r"""
        WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t GROUP BY source),
        w AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
        l AS (SELECT *, cap / weight AS cap_by,
                     (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        m AS (SELECT *, (SELECT arg_min(level, (cap_by, rank)) FROM l WHERE NOT level * weight > cap) AS lvl FROM l),
        g AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * weight) END AS target FROM m),
        r AS (SELECT t.doc_id, t.size, g.source_size, g.target,
                     coalesce(sum(t.size) OVER (PARTITION BY t.source ORDER BY md5(CAST(t.doc_id AS VARCHAR)), t.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
                     CAST(floor(g.target + 0.5) AS BIGINT) AS budget FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
                    + greatest(0, least(size, budget - (budget // source_size) * source_size - run)) END AS BIGINT) AS taken FROM r""",
}
