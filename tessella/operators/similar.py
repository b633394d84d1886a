"""Documents whose TF-IDF vectors are alike: exact, over all pairs of different vectors.

Common words give most documents of a language a cosine well above 0.5, so an inverted index proposes nearly every pair.
Here every two blocks of vectors meet in one task, which reads both from staged files, so no block is copied by a shuffle.
A bound rules out most products: a vector is projected on a few directions, and no cosine exceeds the product of the
projections plus the product of what is left of both.  Only rows and columns with a pair above the bound are multiplied, in
single precision; what comes near the threshold is computed again in double precision.

What leaves a task is a row a document: the links it has there and its component there.  The work still grows with the
square of the different vectors, the rows that are moved do not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import staged

#: Letter and digit runs of two or more characters without Han characters, which are tokens of one: tokens() of that length.
WORD = re.compile("[^\\W一-龥]{2,}")
#: Documents of one block; two blocks meet in one task.
BLOCK = 2048
#: Documents of one file of blocks.
FILE_ROWS = 20_000
#: Directions of the bound, groups by which vectors are ordered, and rows and columns that it rules out together.
DIRECTIONS, GROUPS, STEP = 48, 64, 256
SAMPLE = 4096
MARGIN = 1e-5
#: Words that a task counts, and links that it holds, before it passes them on.
HELD = 200_000
#: Rows of an Arrow batch.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of whole texts stay small: by default one has up to 10,000 rows, and JVM and worker both hold it."""
    old = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(min(int(old), 500) if int(old) > 0 else 500))
    try:
        yield
    finally:
        spark.conf.set(ROWS, old)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    count: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            count.update(WORD.findall((t.as_py() or "").lower()))
            if len(count) > HELD:
                yield out()
                count = Counter()
    yield out()


def _coded(words: list[str]):
    """Rows (id, text) to (id, codes): numbers of the given words, -1 for others."""
    code = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.array([code.get(w, -1) for w in WORD.findall((t.as_py() or "").lower())], np.int32) for t in b.column(1)]
            ends = np.append(0, np.cumsum([len(c) for c in codes]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(codes) if codes else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "codes"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and the number of the row each is of."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _bigrams(v: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """first * size + second of neighbours that both have a code, and their rows."""
    ok = (row[1:] == row[:-1]) & (v[1:] >= 0) & (v[:-1] >= 0)
    return v[:-1][ok].astype(np.int64) * size + v[1:][ok], row[:-1][ok]


def _bigram_counts(size: int):
    def out(held):
        x, n = (np.concatenate(c) for c in zip(*held, strict=True))
        u, back = np.unique(x, return_inverse=True)
        return u, np.bincount(back, weights=n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for b in batches:
            held.append(np.unique(_bigrams(*_flat(b.column(0)), size)[0], return_counts=True))
            if sum(len(x) for x, _ in held) > HELD:
                held = [out(held)]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held[0]], names=["pair", "n"])
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out(held)], names=["pair", "n"])

    return run


def _term_counts(terms: np.ndarray, size: int):
    """Rows (id, codes) to (id, ix, tf) of those that hold a term; a term's number is ix, its code is that of its word, or
    size + first * size + second."""
    order = np.argsort(terms)
    known = terms[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, row = _flat(b.column(1))
            pairs, pair_row = _bigrams(v, row, size)
            x, r = np.concatenate([v[v >= 0], size + pairs]), np.concatenate([row[v >= 0], pair_row])
            at = np.searchsorted(known, x).clip(max=len(known) - 1)
            hit = known[at] == x
            u, tf = np.unique(r[hit] * len(known) + order[at[hit]], return_counts=True)
            rows, n = np.unique(u // len(known), return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))) for c in (u % len(known), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *lists], names=["id", "ix", "tf"])

    return run


def term_counts(df: DataFrame, id_col: str, text: Column, features: int) -> tuple[DataFrame, np.ndarray]:
    """(id, ix, tf) of the documents that hold one of the `features` commonest terms (words of at least two characters and
    pairs of them; ties by term), by the terms' order, and each term's idf.

    A pair is as common as its rarer word at most, so only pairs of words as common as the last of the `features` commonest
    words are counted."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    with small_batches(spark):
        words = staged(texts.select("text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("cf")), "words")
    top = words.orderBy(F.desc("cf"), "word").limit(features).agg(F.min("cf"), F.count("*")).first()
    least = top[0] if top[1] == features else 1
    words = words.filter(F.col("cf") >= least).orderBy("word").collect() if top[1] else []
    size = len(words)
    if not size:
        return spark.createDataFrame([], f"id {kind}, ix array<int>, tf array<int>"), np.zeros(0)
    with small_batches(spark):
        coded = staged(texts.mapInArrow(_coded([w["word"] for w in words]), f"id {kind}, codes array<int>"), "codes")
    single = spark.createDataFrame([(i, w["word"], w["cf"]) for i, w in enumerate(words)], "code long, term string, cf long")
    first, second = (single.select(F.col("code").alias(c), F.col("term").alias(f"w_{c}")) for c in ("a", "b"))
    pairs = coded.select("codes").mapInArrow(_bigram_counts(size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("cf")).filter(F.col("cf") >= least)
    pairs = pairs.withColumns({"a": F.floor(F.col("pair") / size), "b": F.col("pair") % size}).join(F.broadcast(first), "a").join(F.broadcast(second), "b")
    pairs = pairs.select((size + F.col("pair")).alias("code"), F.concat_ws(" ", "w_a", "w_b").alias("term"), "cf")
    terms = sorted(single.unionByName(pairs).orderBy(F.desc("cf"), "term").limit(features).collect(), key=lambda r: r["term"])
    counts = staged(coded.mapInArrow(_term_counts(np.array([r["code"] for r in terms], np.int64), size), f"id {kind}, ix array<int>, tf array<int>"), "term-counts")
    n, holders = df.count(), np.zeros(len(terms))
    for r in counts.select(F.explode("ix").alias("ix")).groupBy("ix").agg(F.count("*").alias("n")).collect():
        holders[r["ix"]] = r["n"]
    return counts, np.log((1 + n) / (1 + holders)) + 1


def _dense(rows: np.ndarray, ix: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    m = np.zeros((n, len(idf)))
    m[rows, ix] = tf * idf[ix]
    return m / np.sqrt((m * m).sum(1, keepdims=True))


class Block:
    """Vectors of one block: dense in single precision with their projections, any of them in double precision."""

    def __init__(self, ends: bytes, ix: bytes, tf: bytes, n: bytes, idf: np.ndarray, basis: np.ndarray):
        self.ends, self.ix, self.tf, self.n = (np.frombuffer(x, t) for x, t in ((ends, np.int64), (ix, np.int32), (tf, np.int32), (n, np.int64)))
        self.idf, rows = idf, len(self.n)
        self.m = np.empty((rows, len(idf)), np.float32)
        for lo in range(0, rows, STEP):
            self.m[lo : lo + STEP] = self.exact(np.arange(lo, min(lo + STEP, rows)))
        self.p = projected(self.m, basis)

    def exact(self, rows: np.ndarray) -> np.ndarray:
        begin = np.append(0, self.ends)[rows]
        size = self.ends[rows] - begin
        at = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return _dense(np.repeat(np.arange(len(rows)), size), self.ix[at], self.tf[at], len(rows), self.idf)


def projected(m: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projections of unit vectors, and the length of the rest, if anything too long."""
    p = m @ basis
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)) + 4e-6)])


def _plan(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions that hold most of a sample, and centres of groups in their space; they decide on the order and the speed,
    not on the result."""
    basis = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :DIRECTIONS].astype(np.float32)
    p = projected(sample.astype(np.float32), basis)
    centres = p[np.linspace(0, len(p) - 1, min(GROUPS, len(p))).astype(int)].copy()
    for _ in range(10):
        label = (p @ centres.T).argmax(1)
        for k in np.unique(label):
            centres[k] = p[label == k].sum(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return basis, centres


def _placed(idf: np.ndarray, basis: np.ndarray, centres: np.ndarray):
    """Rows (id, ix, tf, n) with the group they are of and how near they are to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                (ix, rows), tf = _flat(part.column(1)), _flat(part.column(2))[0]
                s = projected(_dense(rows, ix, tf, part.num_rows, idf).astype(np.float32), basis) @ centres.T
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.argmax(1).astype(np.int32)), pa.array(s.max(1))], names=["id", "ix", "tf", "n", "part", "near"])

    return run


def _packed(block: int, kind: pa.DataType):
    """Sorted rows (id, ix, tf, n) in blocks, numbered apart from those of other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held = TaskContext.get().partitionId(), 0, []

        def out(part):
            nonlocal k
            k += 1
            ix, tf = part.column(1).combine_chunks(), part.column(2).combine_chunks()
            ends = np.cumsum(ix.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            raw = [x.astype(t).tobytes() for x, t in ((ends, np.int64), (_flat(ix)[0], np.int32), (_flat(tf)[0], np.int32), (part.column(3).to_numpy(), np.int64))]
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([task * 100_003 + k]), ids, *(pa.array([x], pa.binary()) for x in raw)], names=["i", "ids", "ends", "ix", "tf", "n"])

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= block:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, block))
                held = t.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    return run


def _hits(a: Block, b: Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b that are alike; each two rows of one block once."""
    least = threshold - 1e-9
    for x in range(0, len(a.n), STEP):
        for y in range(x if same else 0, len(b.n), STEP):
            may = a.p[x : x + STEP] @ b.p[y : y + STEP].T >= least - MARGIN
            rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(rows):
                continue
            m, o = (blk.m[at : at + STEP] if len(k) > 0.8 * STEP else blk.m[at + k] for blk, at, k in ((a, x, rows), (b, y, cols)))
            rows, cols = (np.arange(len(z)) if len(z) != len(k) else k for z, k in ((m, rows), (o, cols)))
            s = m @ o.T
            i, j = np.divmod(np.flatnonzero(s >= least - MARGIN), s.shape[1])
            near = s[i, j] < least + MARGIN
            i, j = x + rows[i], y + cols[j]
            if same:
                keep = i < j
                i, j, near = i[keep], j[keep], near[keep]
            if near.any():
                at = np.flatnonzero(near)
                keep = np.ones(len(i), bool)
                keep[at] = cosines(a, b, i[at], j[at]) >= least
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def cosines(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *((a.exact(i[k : k + 512]) * b.exact(j[k : k + 512])).sum(1) for k in range(0, len(i), 512))])


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b; label holds a member of each one's component, itself labelled so."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


#: Blocks that a task holds besides the one it takes up: those of a file, which every other one of its rows meets again.
KEPT = 1 + FILE_ROWS // BLOCK
#: Numbers of a row: its block's times this and its place there.
PLACES = 1 << 20


def _meet(idf: np.ndarray, basis: np.ndarray, threshold: float, pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        begin: dict[int, int] = {}
        number, links, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                cols = [c[r].as_py() for c in batch.columns]
                both = []
                for k, *raw in (cols[:5], cols[5:]):
                    if k not in held:
                        while len(held) > KEPT:
                            held.pop(next(x for x in held if x != cols[0]))
                        held[k] = Block(*raw, idf, basis)
                    if k not in begin:
                        begin[k] = len(number)
                        number = np.append(number, k * PLACES + np.arange(len(held[k].n)))
                        links, label = np.append(links, np.zeros(len(held[k].n), np.int64)), np.append(label, np.arange(begin[k], len(number)))
                    both.append((k, held[k], begin[k]))
                (ka, a, at), (kb, b, bt) = both
                for i, j in _hits(a, b, ka == kb, threshold):
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array(number[at + i]), pa.array(number[bt + j]), pa.array(cosines(a, b, i, j))], names=["a", "b", "similarity"])
                        continue
                    links[at : at + len(a.n)] += np.bincount(i, weights=b.n[j], minlength=len(a.n)).astype(np.int64)
                    links[bt : bt + len(b.n)] += np.bincount(j, weights=a.n[i], minlength=len(b.n)).astype(np.int64)
                    join(label, at + i, bt + j)
        if not pairs:
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(links[some]), pa.array(number[label[some]] if len(label) else label)], names=["row", "links", "label"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to fewer ones of the same components."""

    def reduced(a, b):
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        join(label, code[: len(a)], code[len(a) :])
        some = label != np.arange(len(nodes))
        return nodes[some], nodes[label[some]]

    held, n = [(np.zeros(0, np.int64),) * 2], 0
    for b in batches:
        held.append(tuple(b.column(i).to_numpy() for i in range(2)))
        n += b.num_rows
        if n > 4 * HELD:
            held = [reduced(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            n = 0
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in reduced(*(np.concatenate(c) for c in zip(*held, strict=True)))], names=["a", "b"])


class Alike:
    """The comparison of df's documents, as far as its results share it: members (id, rep, n), where rep is the smallest id of
    the documents with the same terms and n their number, and the blocks of the different ones."""

    def __init__(self, df: DataFrame, id_col: str, text: Column, threshold: float, features: int = 1000, block: int = BLOCK):
        self.spark, self.threshold = df.sparkSession, threshold
        counts, self.idf = term_counts(df, id_col, text, features)
        field = counts.schema["id"]
        self.kind = field.dataType.simpleString()
        hashed = counts.withColumns({"h": F.xxhash64("ix", "tf"), "g": F.xxhash64(F.lit("second"), "ix", "tf")})
        groups = staged(hashed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "groups")
        self.members = staged(hashed.select("id", "h", "g").join(groups, ["h", "g"]).select("id", "rep", "n"), "members")
        size = groups.count()
        reps = counts.join(groups.select(F.col("rep").alias("id"), "n"), "id").select("id", "ix", "tf", "n")
        sample = reps.orderBy(F.xxhash64("id")).limit(SAMPLE).collect() if size else []
        flat = [np.concatenate([np.array(r[c]) for r in sample]) for c in ("ix", "tf")] if sample else []
        rows = np.repeat(np.arange(len(sample)), [len(r["ix"]) for r in sample]) if sample else np.zeros(0, int)
        self.basis, centres = _plan(_dense(rows, *flat, len(sample), self.idf)) if sample else (np.zeros((0, 0), np.float32),) * 2
        places = reps.mapInArrow(_placed(self.idf, self.basis, centres), f"id {self.kind}, ix array<int>, tf array<int>, n long, part int, near float")
        files = -(-size // max(block, FILE_ROWS)) + 1 if size > block else 1
        dealt = places.repartitionByRange(files, "part", "near", "id").sortWithinPartitions("part", "near", "id").select("id", "ix", "tf", "n")
        self.blocks = staged(dealt.mapInArrow(_packed(block, None), f"i long, ids array<{self.kind}>, ends binary, ix binary, tf binary, n binary"), "blocks")
        ids = self.blocks.select("i", F.posexplode("ids").alias("at", "id"))
        self.rows = ids.select((F.col("i") * PLACES + F.col("at")).alias("row"), "id")

    def _met(self, pairs: bool, schema: str) -> DataFrame:
        """Of each two blocks one order is kept, by turns, so that tasks have alike shares."""
        cols = ("i", "ends", "ix", "tf", "n")
        left, right = self.blocks.select(*cols), self.blocks.select(*(F.col(c).alias(f"r_{c}") for c in cols))
        odd = (F.col("i") + F.col("r_i")) % 2 == 1
        once = (F.col("i") == F.col("r_i")) | F.when(odd, F.col("i") > F.col("r_i")).otherwise(F.col("i") < F.col("r_i"))
        return left.join(right, once).mapInArrow(_meet(self.idf, self.basis, self.threshold, pairs), schema)

    def pairs(self) -> DataFrame:
        """a, b, similarity of different vectors that are alike."""
        met, rows = self._met(True, "a long, b long, similarity double"), self.rows
        met = met.join(rows.select(F.col("row").alias("a"), F.col("id").alias("x")), "a").join(rows.select(F.col("row").alias("b"), F.col("id").alias("y")), "b")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(id, links): documents that one with different terms is alike; (a, b): links of the same components as the pairs."""
        met = staged(self._met(False, "row long, links long, label long"), "links")
        n = met.groupBy("row").agg(F.sum("links").alias("links")).join(self.rows, "row").select("id", "links")
        edges = staged(met.filter("row <> label").select(F.col("row").alias("a"), F.col("label").alias("b")).repartition(4).mapInArrow(_forest, "a long, b long"), "forest")
        rows = self.rows
        edges = edges.join(rows.select(F.col("row").alias("a"), F.col("id").alias("x")), "a").join(rows.select(F.col("row").alias("b"), F.col("id").alias("y")), "b")
        return n, edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
