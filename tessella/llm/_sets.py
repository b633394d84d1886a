"""Word hashes and shingle sets of whole texts, vectorised over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_LIMIT = 1 << 20


def _rng(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


_LETTER = _rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWER or len(_POWER["up"]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _POWER[name] = np.cumprod(p, dtype=np.uint64)
    return _POWER["up"], _POWER["down"]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each text, first byte and end byte of each word in the joined texts).

    A word's hash is its polynomial over random letter values, taken from prefix sums and mixed."""
    data = b" ".join(texts)
    if lower:
        data = data.lower()  # bytes: A-Z only
    buf = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[buf]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_LETTER[buf] * up[: len(buf)], out=prefix[1:])
        h = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    counts = np.diff(np.searchsorted(begin, bounds))
    return h, counts, begin, end


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, no words none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in [*texts, None]:
        if t is not None and (not group or size + len(t) < _LIMIT):
            group.append(t)
            size += len(t) + 1
            continue
        if group:
            out += _sets(group, k)
        group, size = ([t], len(t)) if t is not None else ([], 0)
    return out


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    h, counts, _, _ = word_hashes(texts)
    with np.errstate(over="ignore"):
        s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            s += h[j : j + len(s)] * _PLACE[j]
        s = mix(s)
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                v = np.sort(s[at : at + n - k + 1])
                out.append(v[np.append(True, v[1:] != v[:-1])])
            elif n:
                out.append(mix(np.array([int((h[at : at + n] * _PLACE[:n]).sum()) + n * 0x1234567 & _MASK], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
