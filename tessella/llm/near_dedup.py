"""MinHash near-dedup with tensored banding.

A document's set is its distinct k-word shingles.  Two collections of `TENSOR` sub-keys, of two minhashes each, are
combined pair by pair into TENSOR x TENSOR table keys of four minhashes: 64 tables for 32 hash evaluations instead of
256.  A pair of similarity 0.85 is missed by all tables with probability 7e-5, one of 0.9 with 3e-6.

Equal sets are collapsed first, so copies of any number count once.  The rows (table key, node, signature) are
range-sorted by key and node, which spreads a hot key over as many partitions as it needs; a pass over each sorted
partition starts a new leader of a key's run where no signature agrees and compares every leader with the whole run,
so a run costs rows x leaders and emits one candidate a row and agreeing leader, never all pairs.  Of two alike rows
under different leaders each is thereby compared with the other's leader too.  Leaders of runs that touch a
partition's border meet in a second, small pass.

Candidates are confirmed on full shingle sets of the whole texts.  Confirmed links are contracted by alternating
large-star and small-star steps with every round written to the shared folder.  The leader of a run is its hub, the row
nearest to all others, so copies with different edits meet at their origin.  Families whose leader some follower
missed are banded again on fresh hashes, without leaders; there, rows of two components that share a key and agree in
nearly as many of 2,048 minhash bits as a similarity of 0.85 gives are candidates, each pair once.  The nearest of each
row are confirmed first, then what still crosses components.

Defined results: null, empty or blank text has an empty set, links with nothing and keeps itself; fewer words than k
are one shingle; rows that share an id are one node; ids are integers, a null id is replaced by a hash of its set;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._sets import mix, overlap, shingle_sets
from tessella.llm._shared import files_for, staged, whole_text

TENSOR = 8
HASHES = 4 * TENSOR
THRESHOLD = 0.85
K = 5
#: Signatures that agree in fewer places than this are not candidates; at similarity 0.85 that happens once in 50,000.
AGREE = 17
#: Tables and hashes a table of the second banding, which takes the families that the leaders left in pieces: a pair of
#: similarity 0.85 shares none with probability 8e-5.
DEEP_TABLES, DEEP_HASHES = 20, 6
#: Bits of the second banding's signatures, each the last bit of a further minhash.  So many agree at least; at similarity
#: 0.85 fewer do once in 70,000, at 0.76 as many do once in 500.
DEEP_BITS, DEEP_AGREE = 2048, 1845
#: Pairs of one node that are confirmed in one block.
HUB = 256
#: A table key of the second banding with more rows is dealt out in blocks of about so many, each two of which meet.
CELL = 2048

_R = np.random.Generator(np.random.PCG64(5))
_MUL = _R.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TABLE = mix(np.arange(1, TENSOR * TENSOR + 1, dtype=np.uint64)).reshape(TENSOR, TENSOR)
_HIGH = np.uint64(32)
_DEEP_MUL = _R.integers(1, 1 << 63, DEEP_TABLES * DEEP_HASHES + DEEP_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DEEP_ADD = _R.integers(0, 1 << 63, DEEP_TABLES * DEEP_HASHES + DEEP_BITS, dtype=np.uint64)
_DEEP_TABLE = mix(np.arange(1, DEEP_TABLES + 1, dtype=np.uint64))
_DEEP_PLACE = mix(np.arange(1, DEEP_HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def minhashes(s: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """Minima of multiply-add-shift hashes."""
    with np.errstate(over="ignore"):
        low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 4096):
            low = np.minimum(low, (s[at : at + 4096, None] * mul + add).min(0))
        return (mix(low) >> _HIGH).astype(np.uint32)


def table_keys(sig: np.ndarray) -> np.ndarray:
    """[rows, HASHES] signatures to [rows, TENSOR * TENSOR] keys: every pair of sub-keys of the two collections."""
    with np.errstate(over="ignore"):
        pair = sig.astype(np.uint64).reshape(len(sig), 2 * TENSOR, 2)
        sub = mix((pair[:, :, 0] << _HIGH) | pair[:, :, 1])
        a, b = sub[:, :TENSOR], sub[:, TENSOR:]
        return mix(a[:, :, None] * np.uint64(3) + mix(b)[:, None, :] + _TABLE).reshape(len(sig), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * w + 1, w, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal widths as [rows, width]."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sha(id_col: str, text_col: str) -> Column:
    """What tells rows with a null id apart; null where there is an id."""
    return F.when(F.col(id_col).cast("long").isNull(), F.sha2(whole_text(text_col), 256))


def set_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id, n (set size), f1, f2 (the set's fingerprint), sig, and of a null id the text's sha256."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = shingle_sets(_utf8(part.column(1)), k)
                sig = np.zeros((len(sets), HASHES), np.uint32)
                f = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        sig[i] = minhashes(s)
                        f[0, i] = s.sum(dtype=np.uint64)
                        f[1, i] = mix(s).sum(dtype=np.uint64)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), _binary(sig.view(np.uint8)), part.column(2)], names=["id", "n", "f1", "f2", "sig", "sha"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("whole"), _sha(id_col, text_col).alias("sha"))
    return rows.mapInArrow(build, "id long, n long, f1 long, f2 long, sig binary, sha string")


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            sig = _bytes_of(part.column(1), 4 * HASHES).view(np.uint32)
            keys = table_keys(sig).view(np.int64)
            t = keys.shape[1]
            node = np.repeat(part.column(0).to_numpy(), t)
            small = np.repeat((sig & np.uint32(0xFF)).astype(np.uint8), t, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), _binary(small)], names=["key", "node", "sig"])


def _hub(s: np.ndarray) -> int:
    """The first of the rows that are nearest to all: of few rows those that agree most with the others, of many those
    that agree most with the commonest value of each place.  In a family of copies with different edits that is their
    origin or a row close to it; taking the first makes the tables name the same few leaders."""
    if len(s) < 3:
        return 0
    if len(s) <= 64:
        near = (s[:, None] == s[None]).sum((1, 2))
        return int((near >= 0.95 * near.max()).argmax())
    common = np.array([np.bincount(s[:, j], minlength=256).argmax() for j in range(s.shape[1])], np.uint8)
    near = (s == common).sum(1)
    return int((near >= near.max() - 2).argmax())


def _follow(n: np.ndarray, s: np.ndarray) -> tuple[list, list]:
    """Leaders (places) of a whole run and the pairs (leader, row) of each leader with every row that it agrees with.  A
    row that agrees with no leader so far leads in turn; its later leaders see it too, so rows alike meet at one at least."""
    pairs, leaders, rest = [], [], np.arange(len(n))
    while len(rest):
        i = rest[_hub(s[rest])]
        agree = (s == s[i]).sum(1) >= AGREE
        hit = np.flatnonzero(agree & (n != n[i]))
        pairs.append((np.full(len(hit), n[i]), n[hit]))
        leaders.append(i)
        rest = rest[~agree[rest]]
    return leaders, pairs


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: candidates (a = leader, b = follower), and leaders of the partition's edge runs.  A run
    is held until it ends, whatever batches it comes in; it is no larger than its partition."""
    held: list = []  # the run that goes on: (node, sig) parts
    key, edge = None, True  # edge: the run began the partition

    def close(last: bool = False):
        """Pairs of the held run, and its leaders where it touches a border of the partition."""
        n, s = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(n) == 1:  # most runs
            return [], [(key, n[0], s[0])] if edge or last else []
        leaders, pairs = _follow(n, s)
        return pairs, [(key, n[i], s[i]) for i in leaders] if edge or last else []

    def out(pairs, edges):
        a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
        b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
        at, inverse = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
        n, m = len(at), len(edges)
        ek = pa.array([e[0] for e in edges], pa.int64())
        en = pa.array([int(e[1]) for e in edges], pa.int64())
        es = pa.array([e[2].tobytes() for e in edges], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(at[:, 0]), en]), pa.concat_arrays([pa.array(at[:, 1]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(inverse.astype(np.int64)), pa.nulls(m, pa.int64())]),
             pa.concat_arrays([pa.nulls(n, pa.int64()), ek]), pa.concat_arrays([pa.nulls(n, pa.binary()), es])],
            names=["a", "b", "tables", "key", "sig"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        s = _bytes_of(batch.column(2), HASHES)
        starts = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(k)))
        pairs, edges = [], []
        if held and k[0] != key:
            more, edges = close()
            pairs += more
            held, edge = [], False
        key = k[0] if not held else key
        held.append((n[: sizes[0]], s[: sizes[0]]))
        if len(starts) > 1:  # the first run ends here; the last one may go on
            more, ends = close()
            pairs, edges = pairs + more, edges + ends
            inner = np.arange(len(starts))
            inner = (inner > 0) & (inner < len(starts) - 1)
            two = starts[inner & (sizes == 2)]
            if len(two):
                hit = two[((s[two] == s[two + 1]).sum(1) >= AGREE) & (n[two] != n[two + 1])]
                pairs.append((n[hit], n[hit + 1]))
            for j in np.flatnonzero(inner & (sizes > 2)):
                pairs += _follow(n[starts[j] : starts[j] + sizes[j]], s[starts[j] : starts[j] + sizes[j]])[1]
            held, key, edge = [(n[starts[-1] :], s[starts[-1] :])], k[starts[-1]], False
        yield out(pairs, edges)
    if held:
        yield out(*close(last=True))


def _deep_band(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, label, whole to the rows of the second banding: key, table, node, label, the short forms of all keys, bits."""
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                sig = np.stack([minhashes(s, _DEEP_MUL, _DEEP_ADD) for s in shingle_sets(_utf8(part.column(2)), k)])
                banded = sig[:, : DEEP_TABLES * DEEP_HASHES].astype(np.uint64).reshape(len(sig), DEEP_TABLES, DEEP_HASHES)
                with np.errstate(over="ignore"):
                    keys = mix((banded * _DEEP_PLACE).sum(2, dtype=np.uint64) + _DEEP_TABLE)
                short = np.repeat((keys >> _HIGH).astype(np.uint32).view(np.uint8).reshape(len(sig), -1), DEEP_TABLES, axis=0)
                bits = np.repeat(np.packbits((sig[:, DEEP_TABLES * DEEP_HASHES :] & np.uint32(1)).astype(np.uint8), axis=1), DEEP_TABLES, axis=0)
                node, label = (np.repeat(part.column(i).to_numpy(), DEEP_TABLES) for i in range(2))
                table = np.tile(np.arange(DEEP_TABLES, dtype=np.int32), len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(table), pa.array(node), pa.array(label), _binary(short), _binary(bits)], names=["key", "table", "node", "label", "keys", "bits"])

    return run


def _cell_pairs(n: np.ndarray, c: np.ndarray, block: np.ndarray, keys: np.ndarray, bits: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cell's rows that are in two components, agree in DEEP_AGREE bits and meet in no table before this one:
    lesser, greater, bits that agree.  Where the cell joins two blocks of a key, only pairs across them."""
    a, b, g = [], [], []
    joins = (block != block[0]).any()
    for lo in range(0, len(n), 64):
        differ = c[lo : lo + 64, None] != c[None]
        differ &= n[lo : lo + 64, None] < n[None]
        if joins:
            differ &= block[lo : lo + 64, None] != block[None]
        i, j = np.nonzero(differ)
        for at in range(0, len(i), 1 << 14):
            x, y = lo + i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            agree = DEEP_BITS - np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            hit = np.flatnonzero(agree >= DEEP_AGREE)
            hit = hit[~(keys[x[hit], :table] == keys[y[hit], :table]).any(1)]
            a.append(n[x[hit]])
            b.append(n[y[hit]])
            g.append(agree[hit])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(v or [none]).astype(np.int64) for v in (a, b, g))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, table, node, label, block, keys, bits) sorted by key: the pairs of each whole cell, however many batches
    it takes."""
    held: list = []

    def out(cells):
        cols = [np.concatenate(x) for x in zip(*cells, strict=True)] if cells else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "agree"])

    def pairs(parts):
        return _cell_pairs(*(np.concatenate([p[i] for p in parts]) for i in range(2, 7)), parts[0][1])

    for b in batches:
        if not b.num_rows:
            continue
        k, t, n, c, block = (b.column(i).to_numpy() for i in range(5))
        keys, bits = _bytes_of(b.column(5), 4 * DEEP_TABLES).view(np.uint32), _bytes_of(b.column(6), DEEP_BITS // 8)
        starts = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
        done = []
        for lo, hi in zip(starts, np.append(starts[1:], len(k)), strict=True):
            if held and held[0][0] != k[lo]:
                if sum(len(p[2]) for p in held) > 1:
                    done.append(pairs(held))
                held = []
            held.append((k[lo], int(t[lo]), n[lo:hi], c[lo:hi], block[lo:hi], keys[lo:hi], bits[lo:hi]))
        yield out(done)
    if held:
        yield out([pairs(held)])


def _confirm(threshold_percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a = part.column(0).to_numpy()
                need = {}
                for i, x in enumerate(a.tolist()):
                    need.setdefault(x, i)
                missing = [i for x, i in need.items() if x not in last]
                texts = part.column(2).cast(pa.binary())
                found = shingle_sets([texts[i].as_py() for i in missing], k) if missing else []
                last = {x: last[x] for x in need if x in last} | {int(a[i]): s for i, s in zip(missing, found, strict=True)}
                own = shingle_sets(_utf8(part.column(3)), k)
                inter, union = [], []
                for x, s in zip(a.tolist(), own, strict=True):
                    both = overlap(last[x], s)
                    inter.append(both)
                    union.append(len(last[x]) + len(s) - both)
                i, u = np.array(inter, np.int64), np.array(union, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((u > 0) & (100 * i >= threshold_percent * u)), pa.array(i / np.maximum(u, 1))], names=["a", "b", "linked", "jaccard"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, k: int = K, files: int | None = None) -> DataFrame:
    """a, b, linked, jaccard of each pair, on full sets.  texts: node, whole.  A node `a` of many pairs is dealt out in
    blocks of about HUB of them, each with a copy of its text, so a hub's followers and their texts meet in no one task."""
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("blocks"))
    dealt = pairs.select("a", "b").join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block"))
    left = dealt.join(texts.select(F.col("node").alias("b"), F.col("whole").alias("text_b")), "b")
    heads = texts.select(F.col("node").alias("a"), F.col("whole").alias("text_a")).join(hubs, "a", "left")
    heads = heads.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("blocks", F.lit(1)) - 1).cast("long"))).alias("block"))
    both = left.join(heads, ["a", "block"]).select("a", "b", "text_a", "text_b")
    done = both.mapInArrow(_confirm(round(100 * threshold), k), "a long, b long, linked boolean, jaccard double")
    return staged(done.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.max("jaccard").alias("jaccard")), "links", files=files)


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, label (the smallest node of its component) for every node with an edge."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").dropDuplicates(), "edges", files=files)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").dropDuplicates()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = staged(small.filter("u <> v").dropDuplicates(), "edges", files=files)
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        if new.agg(*mark).first() == now.agg(*mark).first():
            break
        now = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).dropDuplicates())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    return _groups(docs, id_col, text_col, threshold, k).drop("_sha")


def _groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """near_groups() and _sha."""
    sets = staged(set_table(docs, id_col, text_col, k), "sets")
    filled = sets.filter("n > 0")
    n_docs = sets.count()
    reps = staged(filled.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")).select(F.coalesce("id", "f1").alias("node"), "f1", "f2", "sig"), "nodes", files=files_for(5 * n_docs))  # rows of a few hundred bytes
    rows = reps.select("node", "sig").mapInArrow(_band, "key long, node long, sig binary")
    what = "a long, b long, tables long, key long, sig binary"
    found = staged(rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_candidates, what), "candidates")
    edges = found.filter("b is null").select("key", F.col("a").alias("node"), "sig")
    over = edges.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates, what).filter("b is not null")
    pairs = found.filter("b is not null").unionByName(over).groupBy("a", "b").agg(F.sum("tables").alias("tables"))
    files = files_for(found.filter("b is not null").count())  # what follows has at most a few rows for each of these
    pairs = staged(pairs, "pairs", files=files)
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).dropDuplicates()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), whole_text(text_col).alias("whole"), _sha(id_col, text_col).alias("sha"))
    unnamed = filled.filter("id is null").groupBy("sha").agg(F.min("f1").alias("f1"))
    unnamed = texts.filter("node is null").join(unnamed, "sha").groupBy("f1").agg(F.min("whole").alias("whole"))  # one text of each set
    texts = texts.filter("node is not null").select("node", "whole").unionByName(unnamed.select(F.col("f1").alias("node"), "whole"))
    texts = staged(texts.join(needed.hint("merge"), "node", "left_semi"), "texts", files=files_for(50 * n_docs, 16))  # whole texts

    # the leader that most tables name first; then what still crosses components
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("tables", (-F.col("a")).alias("x"))).alias("a")).select("a", "b")
    first = confirm(best, texts, threshold, k, files)
    label = components(first.filter("linked"), files)
    crossing = _across(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), label)
    second = confirm(crossing, texts, threshold, k, files)
    tested = first.unionByName(second)
    if not second.filter("linked").isEmpty():
        label = components(tested.filter("linked"), files)
    deep = _deep_pairs(tested, pairs, texts, label, k)
    if not deep.isEmpty():
        # the nearest of each first: what they join leaves fewer pairs to be read; then every pair that still crosses
        near = deep.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
        near = near.unionByName(deep.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b")).select("a", "b")).dropDuplicates()
        for some in (near, deep.select("a", "b")):
            more = confirm(_across(some.join(tested, ["a", "b"], "left_anti"), label), texts, threshold, k, files)
            tested = staged(tested.unionByName(more), "tested", files=files)
            if not more.filter("linked").isEmpty():
                label = components(tested.filter("linked"), files)

    label = label.withColumnRenamed("node", "l_node")
    groups = reps.select("node", "f1", "f2").join(label, F.col("node") == F.col("l_node"), "left").select("f1", "f2", F.coalesce("label", "node").alias("component_id"))
    out = filled.join(groups, ["f1", "f2"]).select("id", F.coalesce("id", "f1").alias("node"), "n", "component_id", "sha")
    out = out.unionByName(sets.filter("n = 0").select("id", F.col("id").alias("node"), "n", F.col("id").alias("component_id"), "sha"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("node").eqNullSafe(F.col("component_id")).alias("kept"), F.col("sha").alias("_sha"))


def _deep_pairs(tested: DataFrame, pairs: DataFrame, texts: DataFrame, label: DataFrame, k: int) -> DataFrame:
    """a, b, agree: of the families whose leader some follower missed, all pairs in two components that meet in a table
    of the second banding and agree there, each once.  The leaders play no part in it.  A key of many rows is dealt out
    in blocks of which each two meet."""
    failed = staged(_across(tested.filter("not linked").select("a", "b"), label), "failed")
    heads = failed.select("a").dropDuplicates()
    family = pairs.join(heads, "a", "left_semi").select(F.col("b").alias("node"))
    nodes = family.unionByName(heads.select(F.col("a").alias("node"))).unionByName(failed.select(F.col("b").alias("node"))).dropDuplicates()
    nodes = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    whole = nodes.join(texts, "node").select("node", "label", "whole")
    rows = staged(whole.mapInArrow(_deep_band(k), "key long, table int, node long, label long, keys binary, bits binary"), "deep-rows")
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    rows = rows.join(hot, "key", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("blocks", F.lit(1)) - 1).cast("long"))))
    rows = rows.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "j"), F.greatest("block", "j"))).alias("key"), "table", "node", "label", "block", "keys", "bits")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_cells, "a long, b long, agree long")
    return staged(found.dropDuplicates(["a", "b"]), "deep-pairs")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*pairs.columns)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group; every column stays."""
    stay = _groups(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("_stays"), F.col("_sha").alias("_stays_sha"))
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay["_stays"]) & _sha(id_col, text_col).eqNullSafe(stay["_stays_sha"]), "left_semi")
