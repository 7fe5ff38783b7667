"""Vectorised word hashing: whole batches of texts become arrays of 64-bit word hashes without a loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
NOT_WORD = re.compile(r"[\W_]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, int(n).bit_length()))[:n]


def normal(text: str) -> bytes:
    """Lower case; every run of characters that are neither letters nor digits counts as one space."""
    low = text.lower()
    return low.encode() if low.isascii() else NOT_WORD.sub(" ", low).encode("utf-8", "replace")


def words_and_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts one after the other, their lengths in bytes, offsets: text i has
    words[offsets[i]:offsets[i + 1]])."""
    parts = [normal(t) for t in texts]
    buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    is_word = _IS_WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)))
    hashes = mix((total[end - 1] - total[start - 1]) * powers(_UNBASE, len(buf))[start])
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes, end - start, np.searchsorted(start, at + 1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`words_and_bytes` without the lengths."""
    hashes, _, at = words_and_bytes(texts)
    return hashes, at


def in_chunks(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, in lists of about `most` characters; a longer text stands alone."""
    out, n = [], 0
    for t in texts:
        if out and n + len(t) > most:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and offsets per text. A text of 1 to n-1 words has one shingle, all its words."""
    count = np.diff(offsets)
    full = np.maximum(count - n + 1, 0)
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h *= U(_BASE)
            h += words[k : len(words) - n + 1 + k]
        h = mix(h)
    else:
        h = np.zeros(0, np.uint64)
    per = np.where(full > 0, full, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(out_at[-1], np.uint64)
    long = np.flatnonzero(full > 0)
    src = np.repeat(offsets[long] - out_at[long], full[long])
    dst = np.flatnonzero(np.repeat(full > 0, per))
    out[dst] = h[dst + src]
    for i in np.flatnonzero((full == 0) & (count > 0)):
        x = np.full(1, count[i], np.uint64)
        for k in range(offsets[i], offsets[i + 1]):
            x = mix(x * U(_BASE) + words[k : k + 1])
        out[out_at[i]] = x[0]
    return out, out_at
