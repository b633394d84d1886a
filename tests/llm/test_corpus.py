import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, pii, quality_cnn, quality_rules, token_counts
from tessella.llm._tokens import encoder

from .helpers import edge_docs, empty_docs, generated, words


# tokens and packing ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_fast_encoder_equals_the_library(spark, reference):
    for _, t in [(r.doc_id, r.text) for r in generated(spark).collect()] + [(0, "<|endoftext|> a  b\n\n\té漢🙂'll 12345"), (0, "")]:
        assert encoder()(t or "").tolist() == reference(t)


def test_other_tokenizer_files_go_through_the_library(reference):
    assert encoder("word_bpe_49k.json")("Hello there").tolist()


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_packing_round_trip(spark, make, reference):
    docs = make(spark)
    got = packing.pack(docs, with_ids=True).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = reference(t) + [0]
        cut = len(ids) if len(ids) <= 2048 else (len(ids) % 2048 or 2048)
        start = k = 0
        while start < len(ids):
            want[i, k, start, cut - start, zlib.crc32(np.array(ids[start:cut], "<u4").tobytes())] += n
            start, cut, k = cut, cut + 2048, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_vector_capacities_hold():
    for rule in ("norm", "dot"):
        plan = packing.best_fit({900: 7, 300: 11, 20: 50, 1: 9}, 1000, max_docs=5, max_cost=850_000.0, rule=rule)
        load = defaultdict(list)
        for length, _, many, first, _ in plan:
            for s in range(first, first + many):
                load[s].append(length)
        assert Counter(x for b in load.values() for x in b) == {900: 7, 300: 11, 20: 50, 1: 9}
        for b in load.values():
            assert sum(b) <= 1000 and len(b) <= 5 and sum(x * x for x in b) <= 850_000


def test_a_piece_over_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit({11: 1}, 10)


def test_packing_of_nothing(spark):
    assert packing.pack(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_token_histogram(spark, make, reference):
    docs = make(spark)
    sizes = [len(reference(r.text)) for r in docs.select("text").collect()]
    got = token_counts.context_limits(token_counts.length_histogram(docs)).collect()
    assert {r.length: r.n_docs for r in got} == Counter(sizes)
    for r in got:
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)
        assert (r.docs_up_to, r.docs_longer) == (sum(s <= r.length for s in sizes), sum(s > r.length for s in sizes))
        assert r.quantile == pytest.approx(r.docs_up_to / len(sizes))


def test_token_histogram_of_nothing(spark):
    assert token_counts.context_limits(token_counts.length_histogram(empty_docs(spark))).count() == 0


# mixing ------------------------------------------------------------------------------------------------------------


def mix_brute(rows):
    sizes = defaultdict(list)
    for i, t, s in rows:
        sizes[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, len(words(t))))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in sizes[s]) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    share, open_, target = 1.5 * sum(total.values()), set(order), {}
    while open_:
        level = (share - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * total[s] for s in over}
        open_ -= over
    return target, total, sizes


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_mixing_meets_its_targets(spark, make):
    docs = make(spark)
    target, total, sizes = mix_brute([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()])
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == total[r.src] and r.target == pytest.approx(target[r.src])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.src] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_mixed_documents_have_the_taken_words(spark):
    docs = generated(spark)
    plan = mixing.mix(docs).groupBy("src").agg(F.sum("taken").alias("t")).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("n")).collect()}
    assert got == {r.src: r.t for r in plan if r.t}


def test_mixing_of_nothing(spark):
    assert mixing.mix(empty_docs(spark)).count() == 0


# personal data -----------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit_pii(spark)


TRICKY = [
    "a@b.c_x@d.e f@g h@i.j.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111-1111 1111 and 4111111111111112 4111-1111-1111-1111", "+1 (743) 555-3824 +12 +1234567890123456 +44 20 7946 0958.", "é+1 743 555 3824 ü@x.de ñ1.2.3.4\n4111\n1111",
    "", "9" * 3000, "a" * 3000, "x@" * 500, "1." * 500, "call (743) 555-3824 now", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" x', "mail ann (at) mail.example (dot) com", "version 1.2.3.4567 lot 1234 5678",
]


def test_pii_base_equals_brute_force(spark, pii_model):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(1000 + r.doc_id, r.text) for r in generated(spark).collect()] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    for r in pii.find_pii(docs, pii_model).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, texts[r.doc_id] or "") if passes(k, m.group())]
        assert [(b.kind, b.s, b.e) for b in r.base] == want
        assert set(want) <= {(b.kind, b.s, b.e) for b in r.spans}


def test_pii_method_adds_spans_and_leaves_plain_text(spark, pii_model):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.redact(pii.find_pii(docs, pii_model)).collect()}
    assert "phone" in {s.kind for s in got[10].spans} and got[10].redacted == "call [phone] now"
    assert "secret" in {s.kind for s in got[11].spans}
    assert "email" in {s.kind for s in got[12].spans}
    clean = spark.createDataFrame([(i, t) for i, t in enumerate(["the ratio is 123.456.7890 of it", "chapter 12, page 345", "Nothing here at all.", "key = value"])], "doc_id long, text string")
    assert all(not r.spans for r in pii.find_pii(clean, pii_model).collect())


def test_trees_as_columns_equal_numpy(spark):
    from tessella.llm._boost import Boosted

    r = np.random.default_rng(1)
    x = r.random((300, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = [v.p for v in df.select(model.column([F.col("a"), F.col("b"), F.col("c")]).alias("p")).collect()]
    assert np.allclose(got, model.predict(x)) and ((np.array(got) > 0.5) == y).mean() > 0.95


def test_pii_by_kind_on_an_unseen_family(spark, pii_model):
    got = pii.evaluate_pii(spark, pii_model)
    assert set(got) == {"email", "card", "phone", "account", "identity", "secret"}
    assert all(p >= 0.9 and r >= 0.85 for p, r in got.values()), got
    train, calibrate, held = (" ".join(b + s for b, s, _, _ in pii._of_family(900, 3, f)) for f in range(3))
    assert "MAIN" in train and all(cue not in train + calibrate for cue in ("client_secret", "write to", "(AT)")) and "client_secret" in held
    assert any(t != 0.5 for t in pii_model.thresholds.values())


def test_pii_finds_local_phones_and_bare_keys(spark, pii_model):
    texts = ["Telefon 030 123 4567 bitte", "export ghp_a8Kd02jfLs93mXqP0aZt7RbNc5Vy1Wu4EoGh now", "dated 01.11.2024 in the file", "mobil 0171/555.3829 abends"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(docs, pii_model).collect()}
    assert got == {0: ["phone"], 1: ["secret"], 2: [], 3: ["phone"]}


def test_pii_edge_rows(spark, pii_model):
    docs = edge_docs(spark)
    found = pii.redact(pii.find_pii(docs, pii_model)).collect()
    assert len(found) == docs.count() and {r.redacted for r in found if r.doc_id in (4, 5)} == {""}


def test_pii_of_nothing(spark, pii_model):
    assert pii.find_pii(empty_docs(spark), pii_model).count() == 0


# quality -----------------------------------------------------------------------------------------------------------


def rules_brute(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("make", [edge_docs, generated])
def test_quality_rules_base_equals_brute_force(spark, make):
    docs = make(spark)
    field = quality_rules.fit_field(generated(spark), generated(spark, "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = quality_rules.quality_rules(docs, field).collect()
    assert len(got) == docs.count()
    for r in got:
        want = rules_brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(2)
    field = quality_rules.LineField(r.normal(size=(quality_rules.N_FEATURES, 2)), r.normal(size=(2, 2)))
    for _ in range(20):
        x = r.normal(size=(6, quality_rules.N_FEATURES))
        e = x @ field.emit
        score = lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert tuple(field.decode(x)) == max(product((0, 1), repeat=6), key=score)


def best_labels(field, x):
    """The best labelling by trying all; content wins ties."""
    from itertools import product

    e = x @ field.emit
    score = lambda p: sum(e[i, k] for i, k in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False))
    top = max(score(p) for p in product((0, 1), repeat=len(x)))
    return {p for p in product((0, 1), repeat=len(x)) if score(p) > top - 1e-9}


def test_retention_equals_brute_force_over_labellings(spark):
    docs = generated(spark)
    field = quality_rules.fit_field(docs, generated(spark, "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    tried = 0
    for r in quality_rules.quality_rules(docs, field).collect():
        text = texts[r.doc_id] or ""
        lines = text.split("\n")
        if len(lines) > 8:
            continue
        tried += 1
        counts = [len(words(x)) for x in lines]
        shares = {sum(n for n, k in zip(counts, p, strict=True) if k) / max(sum(counts), 1) for p in best_labels(field, quality_rules.line_features(text.encode())[0])}
        assert any(abs(r.content_share - s) < 1e-9 for s in shares)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5) and r.n_lines == len(lines)
    assert tried > 50


def test_lines_of_one_document_get_different_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = generated(spark, sf=sf), generated(spark, "labels", sf)
    field = quality_rules.fit_field(docs, lab)
    got = quality_rules.quality_rules(docs, field)
    assert got.filter("n_content_lines > 0 and n_content_lines < n_lines").count() >= 50
    prose = "The river runs past the old mill and under the bridge before it meets the sea, and nobody has seen where it ends."
    junk = "BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!!"
    text = "\n".join([prose] * 1 + [f"{i}: {prose}" for i in range(6)] + [junk] * 6 + [f"Again {i}: {prose}" for i in range(6)])
    labels = field.decode(quality_rules.line_features(text.encode())[0])
    assert labels[:7].all() and not labels[7:13].any() and labels[13:].all()


def test_evidence_is_by_line():
    x, _ = quality_rules.line_features(b"All rights reserved, licensed to all.\nplain words in a line\n\nplain words in a line\n" + b"te " * 30)
    told = quality_rules.evidence(x, np.array([1, 1, 1, 1, 1]))
    assert [tuple(np.sign(t)) for t in told] == [(0, -1), (-1, 0), (0, 0), (0, -1), (0, -1)]
    assert [tuple(np.sign(t)) for t in quality_rules.evidence(x, np.zeros(5))] == [(0, -1), (0, -1), (0, 0), (0, -1), (0, -1)]


def test_training_takes_every_line_of_long_documents():
    x, _ = quality_rules.line_features(b"some words of a line.\n" * 500)
    told = quality_rules.evidence(x, np.ones(len(x)))
    late = told.copy()
    late[400:, 0], late[400:, 1] = 0, -4
    a, b = (quality_rules.LineField().fit([x], [t], rounds=5) for t in (told, late))
    assert not np.allclose(a.emit, b.emit)


def test_quality_rules_separate_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = generated(spark, sf=sf), generated(spark, "labels", sf)
    got = quality_rules.quality_rules(docs, quality_rules.fit_field(docs, lab)).join(lab, "doc_id").filter("not base_failed")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate.get(0, 0) < 0.3


def test_classifier_holds_out_and_separates(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = generated(spark, sf=sf), generated(spark, "labels", sf)
    net = quality_cnn.fit_quality(docs, lab)
    got = quality_cnn.quality_scores(docs, net).join(lab, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(r.score, r.quality) for r in got if r.held_out]
    good, bad = [s for s, q in test if q], [s for s, q in test if not q]
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    kept = quality_cnn.keep_good(docs, net)
    assert kept.columns == docs.columns and kept.count() == quality_cnn.quality_scores(docs, net).filter("predicted = 1").count()


def test_classifier_edge_rows(spark):
    net = quality_cnn.ByteNet.fresh()
    docs = edge_docs(spark)
    assert quality_cnn.quality_scores(docs, net).count() == docs.count()
    assert {r.score for r in quality_cnn.quality_scores(docs, net).collect()} == {0.5}
    assert quality_cnn.quality_scores(empty_docs(spark), net).count() == 0
    one = net.score([b"x" * 3_000_000, b"", b"abc"])
    assert len(one) == 3
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_cnn.fit_quality(docs, labels).out.sum() == 0


def test_whole_text_counts():
    r = np.random.default_rng(3)
    net = quality_cnn.ByteNet.fresh()
    net.out = r.normal(size=2 * quality_cnn.FILTERS).astype(np.float32)
    a = b"plain words here " * 50_000
    assert net.score([a])[0] != net.score([a + b"### %%% ### " * 50])[0]
    assert np.allclose(net.score([a, b"tail", a[:700]]), [net.score([t])[0] for t in (a, b"tail", a[:700])])


def test_rules_of_nothing(spark):
    assert quality_rules.quality_rules(empty_docs(spark), quality_rules.LineField()).count() == 0
