import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, line_dedup, near_dedup, passages
from tessella.llm._sets import overlap, shingle_sets

from .helpers import SPACE, UPPER, edge_docs, empty_docs, generated, rows_of, words


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    return {n: (min(g)[1], len(g)) for n, g in groups.items()}


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_exact_dedup_equals_brute_force(spark, make):
    docs = make(spark)
    rows = rows_of(docs)
    want = exact_brute(rows)
    texts = dict(rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        n = SPACE.sub("", texts[r.doc_id] or "")
        assert (r.keep_id, r.group_size) == want[n]
        assert r.text_sha256 == hashlib.sha256(n.encode()).hexdigest()
        kept[n] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_splits_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000
    assert got.filter("kept").count() == 2001
    assert exact_dedup.exact_dedup(docs).count() == 2001


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = edge_docs(spark)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(exact_brute(rows_of(docs)))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(empty_docs(spark)).count() == 0


def line_brute(rows):
    owner = {}
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    for i in sorted(split):
        for line in split[i]:
            owner.setdefault(key(line), i)
    return {i: [x for x in ls if len(key(x)) < 10 or owner[key(x)] == i] for i, ls in split.items()}, {i: len(ls) for i, ls in split.items()}


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_line_dedup_equals_brute_force(spark, make):
    docs = make(spark)
    kept, total = line_brute(rows_of(docs))
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept_text) == (total[r.doc_id], total[r.doc_id] - len(kept[r.doc_id]), "\n".join(kept[r.doc_id]))


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fan=2)
    for b in range(5):
        first = spark.range(b * 10, b * 10 + 20).select(F.col("id").alias("h1"), F.lit(1).cast("long").alias("h2"), F.struct(F.lit(b).cast("long").alias("id")).alias("owner"), F.lit(1).cast("long").alias("holders"))
        got = runs.add(first).filter("not fresh").count()
        assert got == (10 if b else 0)
    assert runs.runs().count() == 60 and all(len(x) < 2 for x in runs.levels)
    runs.drop()


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(empty_docs(spark)).count() == 0


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows, percent=85):
    rows = sorted({(i, t) for i, t in rows}, key=lambda r: r[0])
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    seen, parent = set(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for hs in holders.values():
        for n, b in enumerate(hs):
            for a in hs[:n]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {rows[k][0]: (rows[find(k)][0], len(sets[k])) for k in range(len(rows))}


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_near_dedup_equals_brute_force(spark, make):
    docs = make(spark)
    want = near_brute(rows_of(docs))
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.component_id, r.n_shingles) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_dedup_of_a_family_with_different_edits(spark):
    origin = [f"w{i}" for i in range(160)]
    rows = [(500, " ".join(origin))]
    for i in range(300):
        w = list(origin)
        w[(i * 7) % 150] = f"x{i}"
        w[(i * 11 + 60) % 150] = f"y{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_brute(rows)
    got = near_dedup.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (c, _) in want.items()}
    assert near_dedup.near_dedup(docs).count() == len({c for c, _ in want.values()})


def twins_without_an_origin(n=150):
    """Pairs of rows that share two edits (similarity 0.9); all others of the family are about 0.73 to each other."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        at = rng.sample(range(8, 190, 5), 4)
        for j in (0, 1):
            w = [f"w{x}" for x in range(200)]
            w[at[0]], w[at[1]], w[at[2 + j]] = f"x{i}", f"z{i}", f"y{i}_{j}"
            rows.append((2 * i + j, " ".join(w)))
    return rows


def test_near_dedup_joins_followers_that_miss_their_leader(spark):
    rows = twins_without_an_origin()
    want = near_brute(rows)
    assert len({c for c, _ in want.values()}) >= 100
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (c, _) in want.items()}


def test_near_dedup_does_not_depend_on_batches_or_blocks(spark, monkeypatch):
    rows = twins_without_an_origin(60)
    want = near_brute(rows)
    monkeypatch.setattr(near_dedup, "CELL", 4)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "8")
    try:
        got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set(name, old)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (c, _) in want.items()}


def _pass(n, key, sig, size):
    """Pairs and edge leaders of one sorted partition, dealt in batches of `size` rows."""
    full = pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["key", "node", "sig"])
    pairs, edges = set(), set()
    for b in near_dedup._candidates(full.slice(i, size) for i in range(0, len(n), size)):
        for a, f, _, k, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if f is None:
                edges.add((k, a))
            else:
                pairs.add((a, f))
    return pairs, edges


def test_near_dedup_candidates_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 12, 200))
    sig = rng.integers(0, 2, (200, near_dedup.HASHES)).astype(np.uint8)
    want = _pass(range(200), key, sig, 200)
    assert {k for k, _ in want[1]} == {int(key[0]), int(key[-1])}
    for size in (1, 2, 7, 64):
        assert _pass(range(200), key, sig, size) == want
    for lone in (1, 3):
        assert _pass(range(lone), [5] * lone, sig[:1].repeat(lone, 0), 1) == (({(0, 1), (0, 2)} if lone == 3 else set()), {(5, 0)})


def test_near_dedup_rows_meet_every_leader_that_they_agree_with():
    rng = np.random.default_rng(2)
    key, sig = [9] * 300, rng.integers(0, 2, (300, near_dedup.HASHES)).astype(np.uint8)
    pairs, edges = _pass(range(300), key, sig, 50)
    leaders = [n for _, n in edges]
    assert 1 < len(leaders) < 300
    for a in leaders:
        alike = {b for b in range(300) if b != a and (sig[a] == sig[b]).sum() >= near_dedup.AGREE}
        assert {b for x, b in pairs if x == a} == alike
    assert {b for _, b in pairs} | set(leaders) == set(range(300))


def test_near_dedup_of_null_ids(spark):
    text = [" ".join(f"{p}{i}" for i in range(100)) for p in "abc"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1] + " end"), (7, text[2]), (None, text[2]), (None, text[2] + " end"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == 7 and len({r.component_id for r in got if r.n_shingles}) == 3 and sum(r.kept for r in got) == 4
    kept = [r.text for r in near_dedup.near_dedup(docs).collect()]
    assert len(kept) == 4 and text[0] in kept and "" in kept
    assert sum(t in (text[1], text[1] + " end") for t in kept) == sum(t in (text[2], text[2] + " end") for t in kept) == 1


def test_near_dedup_of_nothing(spark):
    assert near_dedup.near_groups(empty_docs(spark)).count() == 0


def test_hashed_sets_equal_true_sets():
    texts = ["a b c d e f", "", "one", "A b\tC d e f g", "x y " * 5000]
    true = [shingles(t) for t in texts]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(s) for s in true]
    assert overlap(got[0], got[3]) == len(true[0] & true[3])


def test_passages_find_planted_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    fuzzy = passage.replace("p20 ", "q20 ").replace("p41 ", "")
    filler = lambda k, n: " ".join(f"f{k}_{i}" for i in range(n))
    rows = [(1, filler(1, 80) + " " + passage + " " + filler(2, 30)), (2, passage + " " + filler(3, 50)), (3, filler(4, 90)), (4, filler(5, 10) + " " + fuzzy + " " + filler(6, 40)), (5, " ".join(f"p{i}" for i in range(30))), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {2, 4}
    assert (got[2].source_id, got[2].start_word, got[2].end_word, got[2].source_start) == (1, 0, 60, 80) and got[2].similarity == 1.0
    assert got[4].start_word == 10 and got[4].end_word == 69 and 0.9 < got[4].similarity < 1.0


def test_passages_of_a_hot_passage_over_many_partitions(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} tail{i}") for i in range(300)], "doc_id long, text string")
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = passages.repeated_passages(docs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.source_id, r.start_word, r.source_start) for r in got} == {i: (0, 0, 0) for i in range(1, 300)}


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_passages_cover_every_exact_repeat(spark, make):
    docs = make(spark)
    text = {i: words(t, lower=True) for i, t in rows_of(docs)}
    first, need = {}, defaultdict(set)
    for i in sorted(text):
        for j in range(len(text[i]) - 49):
            if first.setdefault(tuple(text[i][j : j + 50]), i) != i:
                need[i].add(j)
    cover = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        assert r.source_id != r.doc_id and r.n_words >= 50
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    for i, starts in need.items():
        assert all(j + 25 in cover[i] for j in starts)


def test_passages_of_holders_that_are_neither_first_nor_before(spark):
    r = random.Random(3)
    draw = lambda n: ["".join(r.choices("abcdefghij", k=7)) for _ in range(n)]
    rows, want = [], set()
    for k in range(0, 6000, 1000):
        shared = draw(56)
        pieces = [shared[at : at + 49] for at in range(8)]  # holders of its seeds, none of 50 words
        rows += [(k + at + i, " ".join(draw(30) + p + draw(30))) for at in (0, 101) for i, p in enumerate(pieces)]
        rows += [(k + i, " ".join(shared)) for i in (100, 200)]
        want.add((k + 200, k + 100, 0, 56))
    got = {(x.doc_id, x.source_id, x.start_word, x.end_word) for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got


def test_passages_of_nothing(spark):
    assert passages.repeated_passages(empty_docs(spark)).count() == 0


def test_chain_prefers_text_order():
    import numpy as np

    got = passages.chain(np.array([0, 10, 20, 30]), np.array([100, 5, 120, 130]))
    assert got[0].tolist() == [0, 2, 3]
