"""Vectorised work on the UTF-8 bytes of many texts: words, lines, windows and their 64-bit hashes.

Hashes are deterministic across processes. Two different strings share a hash with
probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_M = U(0x9E3779B97F4A7C15)
_MINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[bool, np.ndarray] = {}

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_T = mix(np.arange(1, 257, dtype=U) * _M)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    p = _powers.get(inverse)
    if p is None or len(p) < n:
        size = max(n, 1 << 19) + 1
        p = np.full(size, _MINV if inverse else _M, U)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if size <= (1 << 20):
            _powers[inverse] = p
    return p


class Spans:
    """Hashes of arbitrary byte ranges of one buffer."""

    def __init__(self, b: np.ndarray):
        self.sums = np.zeros(len(b) + 1, U)
        np.cumsum(_T[b] * powers(len(b))[: len(b)], out=self.sums[1:])
        self.inv = powers(len(b), True)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross the texts' borders: starts, ends, text of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offs[:-1][offs[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offs[1:]
    last[ends[ends > 0] - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(offs[1:], start, side="right")


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and hash of each k consecutive items of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    acc = np.zeros(n, U)
    for i in range(k):
        acc = acc * _M + h[i : i + n]
    ok = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return ok, mix(acc[ok])


def shingle_sets(b: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text (lower case A-Z): counts by text, text of each, hashes in order.

    A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    nd = len(offs) - 1
    b = LOWER[b]
    s, e, doc = runs(~WS[b], offs)
    h = Spans(b).hash(s, e)
    words = np.bincount(doc, minlength=nd)
    at, w = windows(h, doc, k)
    d = doc[at]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(words)))[short]
        acc = np.zeros(len(short), U)
        for i in range(k - 1):
            more = words[short] > i
            acc[more] = acc[more] * _M + h[first[more] + i]
        w = np.concatenate((w, mix(acc + words[short].astype(U) * U(0xA0761D6478BD642F))))
        d = np.concatenate((d, short))
        order = np.argsort(d, kind="stable")
        w, d = w[order], d[order]
    ends = np.cumsum(np.bincount(d, minlength=nd))
    a = 0
    for z in ends.tolist():
        if z - a > 1:
            w[a:z].sort()
        a = z
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    w, d = w[fresh], d[fresh]
    return np.bincount(d, minlength=nd), d, w
