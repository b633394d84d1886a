"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels each line of a document as content or boilerplate from its bytes and
words (symbols, capitals, digits, length, closing punctuation, licence words, words that repeat, lines that came before)
and from the line before it; Viterbi decoding picks the best labelling and the share of words in content lines decides
retention.  Fixed base counts (words, symbols, repeated lines, repeated three-word windows) reject a document first.

Training is weakly supervised and by line.  No line carries its document's label.  Each line carries evidence instead:
a licence line, a run of symbols or exclamation marks, a line whose words mostly repeat and a line that came before
speak for boilerplate in any document; any other line with words speaks for content in a document marked good; and in
a document marked bad it is free, with a weak lean to boilerplate (`LEAN`).  The field maximises the likelihood of the
evidence summed over all labellings that are open (clamped minus free expectations), so free lines get the label their
form and their neighbours suggest, and a bad document may hold content lines and a good one boilerplate.

It uses at most `TRAIN_DOCS` labelled documents, the first by hash of their id (a documented bound), all their lines and
whole texts.  Their lines are reduced to feature bits where they lie; the driver gets eight bytes a line and trains in
numpy on chains of at most `SEGMENT` lines (a longer document is several chains).  Scoring covers every line of every
document in Arrow batches.

Defined results: null or empty text has no words and fails the base rules; without labels the field falls back to
symmetric weights, under which every line is content; extra columns are ignored; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._shared import slices

TRAIN_DOCS = 1500
SEGMENT = 64
KEEP_SHARE = 0.5
MIN_WORDS = 50
#: Log-odds of the evidence of a line that speaks for one label, and of a free line of a bad document.
SURE, LEAN = 4.0, 0.5
#: The symbols of the base count.
SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
LICENCE = re.compile(rb"licen[sc]ed?\b|copyright|all rights reserved|public license|cookie|terms of (use|service)|privacy policy", re.I)

_CLASS = np.zeros(256, np.int8)
_CLASS[[ord(c) for c in SYMBOLS[1:-1]]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
FEATURES = (
    "bias", "symbol", "symbols", "many symbols", "capitals", "mostly capitals", "marks", "many marks", "digits", "many digits", "under 20", "under 40", "under 80", "from 160", "closed", "long words",
    "bars", "no words", "licence", "came before", "some words repeat", "most words repeat",
)
N_FEATURES = len(FEATURES)
BOILERPLATE = [FEATURES.index(f) for f in ("many symbols", "many marks", "licence", "came before", "most words repeat")]
NO_WORDS = FEATURES.index("no words")


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of data (lines end at \\n or the end): features [lines, N_FEATURES] and its words."""
    buf = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = np.maximum(ends - starts, 0)
    kind = _CLASS[buf]
    per = {}
    for k in (1, 2, 3, 5, 6):
        total = np.append(0, np.cumsum(kind == k, dtype=np.int64))
        per[k] = total[ends] - total[starts]
    lines = data.split(b"\n")
    words, fresh, before = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            words[i], fresh[i] = len(w), len(set(w))
            before[i] = line in seen
            seen.add(line)
    n, m = np.maximum(size, 1), np.maximum(words, 1)
    symbol, upper, digit, bang, pipe = ((per[1] + per[6]) / n, per[2] / n, per[3] / n, per[5] / n, per[6] / n)
    last = buf[np.maximum(ends - 1, 0)]
    x = np.zeros((len(ends), N_FEATURES))
    for j, v in enumerate((
        np.ones(len(ends)), symbol > 0, symbol > 0.03, symbol > 0.08, upper > 0.3, upper > 0.7, bang > 0.01, bang > 0.05, digit > 0.1, digit > 0.3,
        size < 20, size < 40, size < 80, size >= 160, np.isin(last, [46, 63, 33]), size / m > 14, pipe > 0.02, words == 0,
    )):
        x[:, j] = v
    for found in LICENCE.finditer(data):
        x[np.searchsorted(ends, found.start()), 18] = 1
    x[:, 19] = before
    x[:, 20] = (words >= 8) & (fresh < 0.6 * words)
    x[:, 21] = (words >= 8) & (fresh < 0.35 * words)
    return x, words


def evidence(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log-potentials [lines, 2] of lines with features x; good: the mark of each line's document."""
    boilerplate = x[:, BOILERPLATE].any(1)
    open_ = ~boilerplate & (x[:, NO_WORDS] == 0)
    out = np.zeros((len(x), 2))
    out[boilerplate, 1] = -SURE
    out[open_ & (good == 1), 0] = -SURE
    out[open_ & (good == 0), 1] = -LEAN
    return out


class LineField:
    """A linear-chain conditional random field with two labels: 0 boilerplate, 1 content."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.step = np.zeros((2, 2)) if step is None else step

    def fit(self, sequences: list[np.ndarray], beliefs: list[np.ndarray], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> LineField:
        """Maximise the mean log-likelihood of the evidence (log-potentials of each line) by Adam on the difference of
        clamped and free forward-backward expectations."""
        cuts = [(s[i : i + SEGMENT], b[i : i + SEGMENT]) for s, b in zip(sequences, beliefs, strict=True) for i in range(0, len(s), SEGMENT)]
        if not cuts:
            return self
        longest = max(len(s) for s, _ in cuts)
        x = np.zeros((len(cuts), longest, N_FEATURES))
        told = np.zeros((len(cuts), longest, 2))
        mask = np.zeros((len(cuts), longest), bool)
        for i, (s, b) in enumerate(cuts):
            x[i, : len(s)], told[i, : len(s)], mask[i, : len(s)] = s, b, True
        both = (mask[:, 1:] & mask[:, :-1])[:, :, None, None]
        theta = np.zeros(N_FEATURES * 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        lines = mask.sum()

        def expected(e: np.ndarray, step: np.ndarray) -> np.ndarray:
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, longest):
                nxt = np.logaddexp(alpha[:, i - 1, 0, None] + step[0], alpha[:, i - 1, 1, None] + step[1]) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], nxt, alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                right = e[:, i + 1] + beta[:, i + 1]
                back = np.logaddexp(right[:, 0, None] + step[:, 0], right[:, 1, None] + step[:, 1])
                beta[:, i] = np.where(mask[:, i + 1, None], back, 0)
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            q = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * both
            return np.concatenate([np.einsum("dlf,dlk->fk", x, p).ravel(), q.sum((0, 1)).ravel()])

        for t in range(1, rounds + 1):
            emit, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            e = x @ emit
            g = (expected(e + told, step) - expected(e, step)) / lines - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return LineField(theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of one document's lines (Viterbi); content wins ties."""
        d = (x @ self.emit).tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = d[0]
        from0, from1 = [], []
        for e0, e1 in d[1:]:
            stay0, cross1 = a + t00, b + t10
            cross0, stay1 = a + t01, b + t11
            from0.append(stay0 <= cross1)
            from1.append(stay1 >= cross0)
            a, b = max(stay0, cross1) + e0, max(stay1, cross0) + e1
        label = int(b >= a)
        out = np.empty(len(d), np.int8)
        out[-1] = label
        for i in range(len(d) - 2, -1, -1):
            label = int(from1[i] if label else from0[i])
            out[i] = label
        return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS[1:-1]))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += bool(line.strip(SPACES))
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        until = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), chars, symbols, dup_lines, repeated


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label to label, bits: one integer of features a line."""
    place = 1 << np.arange(N_FEATURES, dtype=np.int64)
    for b in slices(batches, 200):
        bits = [(line_features((t.as_py() or "").encode("utf-8", "surrogatepass"))[0] @ place).astype(np.int32) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(bits, pa.list_(pa.int32()))], names=["label", "bits"])


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> LineField:
    """Train on at most `most` labelled documents, the first by hash of their id; all their lines count."""
    lab = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("length(_text) > 0").join(F.broadcast(lab), "_id")
    rows = sorted((r["bits"], r["label"]) for r in rows.select("_text", "_y").mapInArrow(_bits, "label int, bits array<int>").collect())
    sequences = [((np.array(bits)[:, None] >> np.arange(N_FEATURES)) & 1).astype(float) for bits, _ in rows]
    return LineField().fit(sequences, [evidence(s, np.full(len(s), y)) for s, (_, y) in zip(sequences, rows, strict=True)])


def quality_rules(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id_col, the base counts, base_failed, n_lines, n_content_lines, content_share, kept."""
    schema = T.StructType().add(id_col, docs.schema[id_col].dataType)
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("n_lines", "long").add("n_content_lines", "long").add("content_share", "double")
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1)
            rows = []
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                base = base_counts(text)
                x, words = line_features(text.encode("utf-8", "surrogatepass"))
                content = field.decode(x).astype(bool)
                share = float(words[content].sum() / max(base[0], 1))
                failed = base[0] < min_words or 100 * base[4] > 50 * base[0]
                rows.append((*base, failed, not failed and share >= keep_share, len(x), int(content.sum()), share))
            if rows:
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(score, schema)
