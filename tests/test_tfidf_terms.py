"""TF-IDF terms: counted inside the row, over pruned pairs of words."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import vectors


def brute(rows, features, bigrams=True):
    tf = defaultdict(Counter)
    for i, text in rows:
        w = [t for t in (text or "").lower().split() if len(t) > 1]
        tf[i].update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] * bigrams)
    cf, df = sum(tf.values(), Counter()), Counter(t for c in tf.values() for t in c)
    top = sorted(cf, key=lambda t: (-cf[t], t))[:features]
    out = {}
    for i, c in tf.items():
        w = {t: c[t] * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t in top if t in c}
        out |= {(i, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    return out


def found(spark, rows, features, bigrams=True):
    d = spark.createDataFrame(rows, "id int, t string").repartition(3)
    got = vectors.tfidf_terms(d, "id", F.col("t"), features, bigrams).collect()
    assert len({(r.id, r.term) for r in got}) == len(got)
    return {(r.id, r.term): r.weight for r in got}


def texts(seed, n, size, words):
    rng = random.Random(seed)
    return [" ".join(words[min(int(rng.expovariate(6 / len(words))), len(words) - 1)] for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("features", [1, 3, 20, 100, 5000])
def test_equal_brute_force(spark, features):
    rows = list(enumerate([*texts(features, 40, 25, [f"w{i}" for i in range(60)]), "", None, "a b c", "W1 w2 Zz zz"]))
    assert found(spark, rows, features) == pytest.approx(brute(rows, features))


@pytest.mark.parametrize("features", [2, 5, 9, 30])
def test_ties_and_words_all_as_rare(spark, features):
    """A pair of two rare words comes before the tied words after it; with more tied words than are held, too."""
    rows = [(1, "ab zz"), (2, "ac zy zx"), (3, " ".join(f"u{i}" for i in range(100))), (4, "aa aa bb aa aa bb")]
    assert found(spark, rows, features) == pytest.approx(brute(rows, features))
    assert found(spark, rows, features, bigrams=False) == pytest.approx(brute(rows, features, bigrams=False))


def test_no_terms(spark):
    assert found(spark, [(1, "ab cd")], 0) == found(spark, [(1, "a b"), (2, None)], 5) == {}


def test_rows_that_share_an_id_are_one_document(spark, monkeypatch):
    monkeypatch.setattr(vectors, "STRETCH", 4)
    rows = [(None if i % 7 == 0 else 5 if i % 2 else i, t) for i, t in enumerate(texts(4, 60, 20, [f"w{i}" for i in range(40)]))]
    assert found(spark, rows, 25) == pytest.approx(brute(rows, 25))


def test_terms_of_documents_are_not_shuffled(spark):
    rows = list(enumerate(texts(9, 400, 800, [f"word{i}" for i in range(500)])))
    d = spark.createDataFrame(rows, "id int, t string").coalesce(2)
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    vectors.tfidf_terms(d, "id", F.col("t"), 100).write.format("noop").mode("overwrite").save()
    assert written() - before < sum(len(t) for _, t in rows) / 2  # before: 6.3 times the text
