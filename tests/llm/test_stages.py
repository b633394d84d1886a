"""Pipeline stages and row-keeping forms of the operators on edge rows, empty tables and clashing column names."""

import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, passages, quality_cnn, quality_rules
from tessella.llm._shared import scratch_root

from .helpers import SF, edge_docs, empty_docs, generated, words
from .test_corpus import mix_brute
from .test_dedup import exact_brute, near_brute

pipeline = pytest.importorskip("corpus_pipeline")
CLASHES = ("m_src", "_size", "row", "id", "n", "key", "first", "cut", "size", "taken", "target", "range", "kept", "digest", "norm", "_stays", "component_id", "sha", "part", "best")


def clashing(docs):
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(f"clash{i}"))
    return docs


def plain(rows, columns=("doc_id", "text", "lang", "source")):
    return Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_of_nothing(spark, name, stage):
    docs = empty_docs(spark)
    out = stage(spark, docs, SF)
    assert out.count() == 0
    if name != pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns


@pytest.mark.parametrize("name,stage", pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, name, stage):
    docs = clashing(edge_docs(spark))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"clash{i}" for i, c in enumerate(CLASHES))
    if name != "source mixing":
        assert not plain(rows) - plain(docs.collect())


def test_quality_stage_keeps_what_the_network_accepts(spark):
    docs = clashing(edge_docs(spark))
    net = quality_cnn.fit_quality(generated(spark), generated(spark, "labels"))
    kept = Counter(r.doc_id for r in quality_cnn.keep_good(docs, net).collect())
    want = Counter(r.doc_id for r in quality_cnn.quality_scores(docs, net).collect() if r.predicted)
    assert kept == want and sum(want.values()) < docs.count() + 1


def test_exact_stage_by_brute_force(spark):
    docs = clashing(edge_docs(spark))
    got = exact_dedup.exact_dedup(docs).collect()
    want = exact_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in want.values())


def test_exact_stage_where_rows_share_an_id(spark):
    docs = spark.createDataFrame([(1, "aaa"), (1, "b"), (2, "b "), (2, "b "), (None, "c"), (3, "c"), (4, None), (5, ""), (5, "")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "aaa"), (2, "b "), (None, "c"), (4, None)])


def test_exact_stage_does_not_depend_on_partitions(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    want = {i for i, _ in exact_brute([(r.doc_id, r.text) for r in docs.collect()]).values()}
    names = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in exact_dedup.exact_dedup(docs).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(set(got)) and set(got) == want


def test_near_stage_by_brute_force(spark):
    docs = clashing(edge_docs(spark))
    got = {r.doc_id for r in near_dedup.near_dedup(docs).collect()}
    assert got == {c for c, _ in near_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]).values()}


def test_mixing_counts_each_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "t")] * 6 + [(2, "x y z", "u"), (2, "p q r", "u"), (None, "n1 n2", "u"), (None, "n3 n4", "u"), (3, None, "v"), (4, "only one source here", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    target, _, _ = mix_brute(rows)
    took = defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 2 * r.size
        took[r.src] += r.taken
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += len(words(r.text))
    for s, t in target.items():
        assert abs(took[s] - t) <= 1 and got[s] == took[s]


def test_mixing_does_not_depend_on_the_ranges(spark, monkeypatch):
    docs = generated(spark)
    want = sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()) == want


def test_cut_documents_are_first_words(spark):
    docs = edge_docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.mixed_documents(docs).collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)


def test_pack_stage_of_edge_rows(spark):
    docs = clashing(edge_docs(spark))
    got = pipeline.pack(spark, docs, SF).collect()
    load = Counter()
    for r in got:
        load[r.sequence_id] += r.length
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()} and max(load.values()) <= 2048


def test_run_equals_the_stages_one_by_one(spark):
    docs = generated(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
    got = pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048


def test_rules_on_clashing_columns(spark):
    docs = clashing(edge_docs(spark))
    assert quality_rules.quality_rules(docs, quality_rules.LineField()).count() == docs.count()


def test_line_runs_go_when_a_run_fails(spark, monkeypatch):
    made = []
    add = line_dedup.LineRuns.add

    def broken(self, first):
        made.append(self)
        if len(self.tables) > 1:
            raise RuntimeError("lost")
        return add(self, first)

    monkeypatch.setattr(line_dedup.LineRuns, "add", broken)
    with pytest.raises(RuntimeError):
        line_dedup.line_dedup(generated(spark))
    assert made and not any(spark.catalog.tableExists(t) for t in made[0].tables)


# passages ----------------------------------------------------------------------------------------------------------


def filler(r, n):
    return [f"f{r.randrange(10**9)}" for _ in range(n)]


def test_passages_whose_pieces_others_held_first(spark):
    r = random.Random(1)
    passage = [f"p{i}" for i in range(120)]
    rows = [(k, " ".join(filler(r, 40) + passage[24 * k : 24 * k + 30] + filler(r, 40))) for k in range(5)]
    rows += [(100, " ".join(filler(r, 50) + passage + filler(r, 20)))]
    rows += [(110 + k, " ".join(filler(r, 40) + passage[20 * k : 20 * k + 30] + filler(r, 40))) for k in range(6)]  # pieces before each holder too
    rows += [(200, " ".join(filler(r, 10) + passage + filler(r, 60)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, x.source_id, x.start_word, x.end_word, x.source_start) for x in got if x.doc_id == 200] == [(200, 100, 10, 130, 50)]


def test_recall_of_scattered_edits(spark):
    r = random.Random(2)
    rows, planted = [], {}
    for rate in (0.05, 0.1, 0.15):
        for k in range(60):
            i = 1000 * int(rate * 100) + 2 * k
            passage = filler(r, 80)
            edited = [f"e{r.randrange(10**9)}" if r.random() < rate else w for w in passage]
            if sum(a == b for a, b in zip(passage, edited, strict=True)) < 0.82 * 80:
                continue
            rows += [(i, " ".join(filler(r, 30) + passage + filler(r, 30))), (i + 1, " ".join(filler(r, 30) + edited + filler(r, 30)))]
            planted.setdefault(rate, []).append(i + 1)
    found = {x.doc_id for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {rate: np.mean([i in found for i in ids]) for rate, ids in planted.items()}
    assert recall[0.05] == 1 and recall[0.1] >= 0.95 and recall[0.15] >= 0.8, recall
    assert found <= {i for ids in planted.values() for i in ids}


def test_contexts_rule_out_no_passage():
    from tessella.llm._sets import word_hashes

    r = random.Random(4)
    able, accepted = [], 0
    for rate in (0.05, 0.15, 0.2, 0.3) * 300:
        passage = filler(r, r.randrange(30, 90))
        at = r.randrange(len(passage) - passages.K + 1)
        other = [w if at <= i < at + passages.K or r.random() > rate else f"e{i}" for i, w in enumerate(passage)]
        left, right = r.randrange(40), r.randrange(40)
        h, g = (word_hashes([" ".join(filler(r, n) + p + filler(r, right)).encode()])[0] for n, p in ((left, passage), (left // 2, other)))
        p, q = np.array([left + at]), np.array([left // 2 + at])
        s, e, _, _, similarity = passages.align(h, g, p, q)
        x, y = passages._context(h, p), passages._context(g, q)
        able.append(passages.hopeful(x, y, 50, 0.8)[0])
        if e - s >= 50 and similarity >= 0.8:
            accepted += 1
            assert able[-1]
    assert accepted > 100
    noise = np.random.default_rng(5).integers(0, 1 << 63, (2, 20000), dtype=np.uint64)
    assert passages.hopeful(*noise, 50, 0.8).mean() < 0.15 and not passages.hopeful(*noise, 50, 0.8).all()


def test_passages_of_one_short_seed(spark):
    r = random.Random(6)
    rows, lone = [], set()
    for k in range(30):  # 17 equal words share a short seed, mostly just one; the rest keeps five words in six
        passage = filler(r, 17) + filler(r, 60)
        edited = [w if i < 17 or i % 6 != 5 else f"e{r.randrange(10**9)}" for i, w in enumerate(passage)]
        pair = [filler(r, 20) + p + filler(r, 20) for p in (passage, edited)]
        rows += [(2 * k, " ".join(pair[0])), (2 * k + 1, " ".join(pair[1]))]
        short = [set(passages.seeds_of(passages.word_hashes([" ".join(p).encode()])[0])[0].tolist()) for p in pair]
        if len(short[0] & short[1]) == 1:
            lone.add(2 * k + 1)
    found = {x.doc_id for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(lone) > 5 and found == {2 * k + 1 for k in range(30)}


def test_passages_do_not_depend_on_partitions(spark):
    docs = generated(spark)
    want = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    names = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and want


def test_seeds_of_many_texts_are_made_at_once(monkeypatch):
    import pyarrow as pa

    r = random.Random(8)
    texts = [" ".join(filler(r, n)) for n in (0, 5, 6, 16, 17, 31, 32, 50, 51, 300)] * 40 + ["again " * 90, None, "a b " * 60] * 20
    r.shuffle(texts)
    want = set()
    for i, t in enumerate(texts):
        want |= {(s, i, p, c) for s, p, c in zip(*(x.tolist() for x in passages.seeds_of(passages.word_hashes([(t or "").encode()])[0])), strict=True)}
    calls, mix = [], passages.mix
    monkeypatch.setattr(passages, "mix", lambda x: calls.append(1) or mix(x))
    out = list(passages._seed(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "whole"])])))
    got = [x for b in out for x in zip(*(c.to_numpy().tolist() for c in b.columns), strict=True)]
    assert len(got) == len(set(got)) and {(s % 2**64, d, p, c % 2**64) for s, d, p, c in got} == want
    assert len(calls) <= 2 * len(out) + 2  # not two a text


def test_passages_leave_no_shuffle_files_or_chains(spark):
    docs = generated(spark)
    root = f"{scratch_root(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"

    def tables():
        return {d for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith(("seeds", "chains", "passage-texts"))}

    def shuffled():
        dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}

    before, there = shuffled(), tables()
    found = passages.repeated_passages(docs)
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert tables() <= there
    assert found.count()


def test_one_word_over_and_over_gives_few_seeds():
    from tessella.llm._sets import word_hashes

    h = word_hashes([b"again " * 3000])[0]
    s, at, _ = passages.seeds_of(h)
    assert len(s) < 600 and at.max() > 2900


# packing -----------------------------------------------------------------------------------------------------------


def sequences(plan):
    load = defaultdict(list)
    for length, _, many, first, _ in plan:
        for s in range(first, first + many):
            load[s].append(length)
    return load


def test_each_capacity_can_reject():
    histogram = {400: 10, 30: 200}
    free = sequences(packing.best_fit(histogram, 1000))
    few = sequences(packing.best_fit(histogram, 1000, max_docs=8))
    cheap = sequences(packing.best_fit(histogram, 1000, max_cost=200_000.0))
    assert max(map(len, free.values())) > 8 >= max(map(len, few.values())) and len(few) > len(free)
    assert max(sum(x * x for x in b) for b in free.values()) > 200_000 >= max(sum(x * x for x in b) for b in cheap.values())
    for load in (free, few, cheap):
        assert Counter(x for b in load.values() for x in b) == histogram


def test_weights_steer_the_choice():
    histogram = {850: 1, 280: 3, 100: 1}  # the last fits beside one long piece, or, less tightly, beside three short ones
    by_tokens, by_docs = (sequences(packing.best_fit(histogram, 1000, max_docs=24, weights=w)) for w in ((1.0, 0.0, 0.0), (1.0, 4.0, 0.0)))
    assert sorted(map(sorted, by_tokens.values())) == [[100, 850], [280, 280, 280]]
    assert sorted(map(sorted, by_docs.values())) == [[100, 280, 280, 280], [850]]
