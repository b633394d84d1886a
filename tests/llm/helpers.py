"""Small tables with every edge case, and brute-force versions."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def edge_rows():
    """(doc_id, text, lang, source): nulls, empties, very long texts, ties, repeats, copies."""
    base = "The quick brown fox jumps over the lazy dog near the old river bank today"
    many = " ".join(f"w{i % 37}x{i % 11}" for i in range(4000))
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "b"), (3, base, "en", None), (4, None, None, "a"), (5, "", "en", "a"), (6, " \t\n ", "en", "c"), (7, many, "en", "a"), (8, many + " tail", "en", "b"),
        (9, base + "\n" + base, "en", "b"), (10, "one", "en", "c"), (11, "é Éß ﬀ 漢字 emoji 🙂 x@y.zz", "fr", "a"), (12, "line one is long\nshort\nline one is long\n\nLINE ONE is long  ", "en", "a"),
        (13, "line one is long", "en", None), (14, base.replace("quick", "slow"), "en", "a"),
    ]
    rows += [(100 + i, "same text in a large group of copies", "en", "hot") for i in range(40)]
    return [*rows, rows[0], rows[3]]


def edge_docs(spark, parts=5):
    """The rows with an extra column whose name clashes with an output column."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    return df.withColumn("kept", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("id", F.lit(-1)).repartition(parts)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def generated(spark, name="documents", sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
