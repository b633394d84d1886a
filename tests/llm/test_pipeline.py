import zlib
from collections import Counter

import pytest

from .helpers import SF, generated, words
from .test_corpus import mix_brute
from .test_dedup import exact_brute, near_brute
from .helpers import SPACE

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_the_brute_force(spark):
    docs = generated(spark)
    quality, exact, near, mix, pack = (f for _, f in pipeline.STAGES)
    good = quality(spark, docs, SF)
    assert good.columns == docs.columns
    scored = {r.doc_id for r in good.collect()}
    labels = {r.doc_id: r.quality for r in generated(spark, "labels").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in scored for i in clean) >= 0.97 * len(clean)

    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = exact(spark, good, SF)
    assert one.columns == docs.columns
    want = {k for k, _ in exact_brute(rows).values()}
    assert {r.doc_id for r in one.collect()} == want

    two = near(spark, one, SF)
    assert two.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {c for c, _ in near_brute(rows).values()}

    three = mix(spark, two, SF)
    assert three.columns == docs.columns
    target, _, _ = mix_brute([(r.doc_id, r.text, r.source) for r in two.collect()])
    got = Counter()
    for r in three.collect():
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())

    last = pack(spark, three, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in three.collect()}


def test_run_gives_packed_pieces(spark):
    got = pipeline.run(spark, SF).collect()
    load = Counter()
    for r in got:
        load[r.sequence_id] += r.length
    assert got and max(load.values()) <= 2048
    assert SPACE and zlib
