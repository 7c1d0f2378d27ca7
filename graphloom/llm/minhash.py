"""Shingle sets, MinHash samples and odd sketches of single texts."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Words whose hashes a worker keeps; the table is emptied when full.
MOST_WORDS = 500_000
U = np.uint64


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            self[w] = h
        return h


@functools.cache
def _words() -> _Words:
    return _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with all bits mixed."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z in lower case.

    A text with fewer words has one shingle, all of its words; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_words().__getitem__, words), U, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, U)
    for k in range(n):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return np.unique(out)


@functools.cache
def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_607)
    return r.integers(0, 2**64, k, U) | U(1), r.integers(0, 2**64, k, U)


def samples(s: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples, each the smallest value of one hash function over the set."""
    a, b = _family(k)
    out = np.full(k, ~U(0))
    for i in range(0, len(s), 512):
        x = s[i : i + 512, None] * a + b
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def odd_sketch(m: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of the samples: each flips the bit that its position and value hash to."""
    at = mixed(m + np.arange(1, len(m) + 1, dtype=U) * U(0x9E3779B97F4A7C15)) % U(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bands(m: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` samples."""
    x = m.reshape(-1, rows)
    out = np.arange(1, len(x) + 1, dtype=U)
    for k in range(rows):
        out = mixed(out * U(0x9E3779B97F4A7C15) + x[:, k])
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
