"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of `WIDTH` bytes slide over the whole document in steps of `STEP`, activations are
max-pooled inside chunks of `CHUNK` bytes (neighbouring chunks share the bytes of the last window), and the chunk
maxima are combined, by mean and by maximum over all chunks, into one logistic probability.  Every byte of every
document is covered; nothing is cut.

Training runs on the driver over at most `TRAIN_DOCS` labelled documents of at most `TRAIN_BYTES` bytes, chosen by
hash (documented bounds); rows whose crc32(id as text) mod 5 is 0 are held out.  Id, language, source and labels are
never inputs of a score.  Scoring is a map over Arrow batches in pieces of bounded size.

Defined results: null or empty text is scored from the bias alone; without labels every score is 0.5; repeated rows get
equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import slices

TRAIN_DOCS = 2000
TRAIN_BYTES = 6000
FOLDS = 5
THRESHOLD = 0.3
WIDTH, STEP, CHUNK, DIM, FILTERS = 12, 4, 256, 6, 24
PIECE = 1 << 18


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS) == 0


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole chunks; which windows start inside a text; the first chunk of each."""
    padded = [(len(t) + WIDTH + CHUNK - 1) // CHUNK * CHUNK for t in texts]
    at = np.append(0, np.cumsum(padded))
    buf = np.zeros(at[-1] + WIDTH, np.uint8)
    live = np.zeros(at[-1] // STEP, bool)
    for t, a in zip(texts, at, strict=False):
        buf[a : a + len(t)] = np.frombuffer(t, np.uint8)
        live[a // STEP : a // STEP + (len(t) + STEP - 1) // STEP] = True
    return buf, live, at[:-1] // CHUNK


@dataclass
class ByteNet:
    embed: np.ndarray  # [256, DIM]
    filters: np.ndarray  # [WIDTH * DIM, FILTERS]
    bias: np.ndarray
    out: np.ndarray  # [2 * FILTERS]
    out_bias: float

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteNet:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(r.normal(0, 0.5, (256, DIM)).astype(f), r.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS, f), 0.0)

    def _pools(self, buf: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activations by chunk [chunks, windows, FILTERS] and the windows' embedded bytes."""
        e = self.embed[buf]
        n = len(live)
        windows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STEP * DIM * e.itemsize, e.itemsize))
        a = windows @ self.filters
        a += self.bias
        np.maximum(a, 0, out=a)
        a *= live[:, None]
        return a.reshape(-1, CHUNK // STEP, FILTERS), windows

    def _combine(self, top: np.ndarray, first: np.ndarray) -> np.ndarray:
        count = np.diff(np.append(first, len(top)))[:, None]
        return np.hstack([np.add.reduceat(top, first) / count, np.maximum.reduceat(top, first)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        buf, live, first = _layout(texts)
        top = []
        for s in range(0, len(live), PIECE // STEP):  # whole chunks, bounded memory even for one huge text
            e = min(len(live), s + PIECE // STEP)
            top.append(self._pools(buf[s * STEP : e * STEP + WIDTH], live[s:e])[0].max(1))
        x = self._combine(np.concatenate(top), first)
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ self.out + self.out_bias, -30, 30)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int | None = None, batch: int = 48, rate: float = 0.01, seed: int = 7) -> ByteNet:
        if not texts:
            return self
        r = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        epochs = epochs or max(10, min(40, 12_000 // len(texts)))
        names = ("embed", "filters", "bias", "out")
        m = {k: 0.0 for k in (*names, "out_bias")}
        v = dict(m)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                buf, live, first = _layout([texts[i] for i in pick])
                a, windows = self._pools(buf, live)
                at = a.argmax(1)  # [chunks, FILTERS]
                top = np.take_along_axis(a, at[:, None], 1)[:, 0]
                x = self._combine(top, first)
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.out_bias, -30, 30)))
                g = (p - y[pick]) / len(pick)
                dx = g[:, None] * self.out
                count = np.diff(np.append(first, len(top)))
                doc = np.repeat(np.arange(len(first)), count)
                dtop = (dx[:, :FILTERS] / count[:, None])[doc] + dx[doc, FILTERS:] * (top >= x[doc, FILTERS:])
                dtop *= top > 0
                chunk, filt = np.nonzero(dtop)
                d = dtop[chunk, filt]
                w = chunk * (CHUNK // STEP) + at[chunk, filt]
                seen = windows[w]
                df = np.zeros_like(self.filters)
                np.add.at(df.T, filt, d[:, None] * seen)
                de = np.zeros_like(self.embed)
                into = (d[:, None] * self.filters.T[filt]).reshape(-1, WIDTH, DIM)
                np.add.at(de, buf[w[:, None] * STEP + np.arange(WIDTH)], into)
                grads = {"embed": de, "filters": df, "bias": np.bincount(filt, d, FILTERS).astype(np.float32), "out": x.T @ g + 1e-4 * self.out, "out_bias": g.sum()}
                t += 1
                for k, q in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
        for k in names:
            setattr(self, k, getattr(self, k).astype(np.float32))
        self.out_bias = float(self.out_bias)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> ByteNet:
    """Train on at most `most` labelled rows outside the held-out fold, the first by hash of their id."""
    lab = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter(F.octet_length("_text").between(1, TRAIN_BYTES))
    rows = sorted((r["_text"], r["_y"]) for r in rows.join(F.broadcast(lab), "_id").select("_text", "_y").collect())
    return ByteNet.fresh().fit([t.encode("utf-8", "surrogatepass") for t, _ in rows], [y for _, y in rows])


def _score_column(net: ByteNet, texts: list[bytes]) -> np.ndarray:
    scores, group, total = [np.zeros(0)], [], 0
    for t in texts:
        group.append(t)
        total += len(t)
        if total > PIECE:
            scores.append(net.score(group))
            group, total = [], 0
    if group:
        scores.append(net.score(group))
    return np.concatenate(scores)


def keep_good(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the network accepts; every column stays and nothing is shuffled."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(_score_column(net, [t or b"" for t in texts]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted."""
    schema = T.StructType().add(id_col, docs.schema[id_col].dataType).add("held_out", "boolean").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = _score_column(net, [t or b"" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores)], names=schema.names)

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("bytes"))
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
