"""SetSketch registers of shingle sets, and the Jaccard similarity they make likely.

A register is the minimum of exponential random variables over the elements of a set, on an exponentially spaced and
truncated scale: ``floor(1 - log_b(min))`` clipped to ``0 .. Q + 1``. The sketch of a union is the elementwise maximum, and two
sketches agree in a register about as often as two random elements of the union lie in both sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

M = 256  #: registers
BASE = 1.001
RATE = 20.0
Q = 65533

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, M + 1, dtype=np.uint64) * _GOLD
_LOG_B = math.log(BASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. Splitting and lower-casing of bytes touch ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if there are fewer words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * _GOLD + h[i: n - span + 1 + i])
    return np.unique(out)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of hashes.

    Every element has a rising sequence of ``M`` values (spacings of ``M`` exponential variables) that visit the registers in an
    order of its own. Only values up to a bound that fills every register matter; the bound grows until it does.
    """
    n = len(elements)
    odd = (mix(elements ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1))
    shift = mix(elements + np.uint64(0x14057B7EF767814F))
    low = np.uint64(M - 1)
    if n <= 48:
        steps = np.arange(M, dtype=np.uint64)
        gaps = -np.log(_uniform(mix(elements[:, None] + _STEPS))) / (M - np.arange(M))
        values = np.cumsum(gaps, axis=1)
        place = ((odd[:, None] * steps + shift[:, None]) & low).astype(np.int64)
        by_register = np.empty_like(values)
        np.put_along_axis(by_register, place, values, axis=1)
        least = by_register.min(axis=0)
    else:
        bound = (math.log(M) + 8.0) / n
        while True:
            least = np.full(M, np.inf)
            e, o, s, x, j = elements, odd, shift, np.zeros(n), 0
            block = min(64, int(M * bound) + 3)  # about as many values as an element has below the bound
            while j < M and len(e):
                steps = np.arange(j, min(M, j + block), dtype=np.uint64)
                gaps = -np.log(_uniform(mix(e[:, None] + _STEPS[j: j + block]))) / (M - steps.astype(np.float64))
                values = x[:, None] + np.cumsum(gaps, axis=1)
                below = values <= bound
                np.minimum.at(least, ((o[:, None] * steps + s[:, None]) & low)[below].astype(np.int64), values[below])
                more = below[:, -1]
                e, o, s, x, j = e[more], o[more], s[more], values[more, -1], j + block
            if least.max() <= bound:
                break
            bound *= 2.0
    return np.clip(np.floor(1.0 - np.log(least / RATE) / _LOG_B), 0, Q + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers (registers left over are not banded)."""
    bands = M // rows
    part = sketch[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _GOLD + part[:, i] + np.uint64(1))
    return key


def _ahead(x: np.ndarray) -> np.ndarray:
    """Chance that one register exceeds another whose set has the share ``1 - x`` of the union to itself and in common."""
    return -np.log1p(-x * (BASE - 1.0) / BASE) / _LOG_B


def likely_jaccard(sketch_u: np.ndarray, sketch_v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from how many registers are greater, less and equal, with known set sizes."""
    more = (sketch_u > sketch_v).sum(axis=1).astype(float)
    less = (sketch_u < sketch_v).sum(axis=1).astype(float)
    same = sketch_u.shape[1] - more - less
    u = n_u / (n_u + n_v)
    v = 1.0 - u

    def loss(j: np.ndarray) -> np.ndarray:
        a = np.clip(_ahead(np.clip(u - v * j, 0, 1)), 1e-12, 1)
        b = np.clip(_ahead(np.clip(v - u * j, 0, 1)), 1e-12, 1)
        return -(more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1)))

    left, right = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak: narrow the interval by thirds
        third = (right - left) / 3.0
        first, second = left + third, right - third
        lower = loss(first) < loss(second)
        right, left = np.where(lower, second, right), np.where(lower, left, first)
    return (left + right) / 2.0
