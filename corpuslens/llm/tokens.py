"""Vectorised word hashing: runs of bytes other than ASCII white space, as unsigned 64-bit numbers.

All arithmetic is modulo 2**64 in numpy. A word's hash is a polynomial over its bytes, put through
an avalanche step. Two different words collide with a probability near 2**-60.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so powers are invertible modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * BASE + U64(seed * 0xD1342543DE82EF95 % (1 << 64)))


_BYTE = numbers(1, 256)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=U64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and ``len(texts) + 1`` word offsets of the texts."""
    if not texts:
        return np.empty(0, U64), np.zeros(1, np.int64)
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1  # first byte after each text and its separator
    offsets = np.concatenate([[0], np.searchsorted(begin, ends)])
    if len(begin) == 0:
        return np.empty(0, U64), offsets
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    place = _places(begin, len(data))
    place[space] = 0
    value = _BYTE[data] * powers(BASE, int((stop - begin).max()))[place]
    value[space] = 0
    return mix(np.add.reduceat(value, begin) + (stop - begin).astype(U64)), offsets


def _places(begin: np.ndarray, n: int) -> np.ndarray:
    """For each byte its distance from the start of the word at or before it (0 before the first)."""
    start = np.zeros(n, dtype=np.int64)
    start[begin] = begin
    np.maximum.accumulate(start, out=start)
    return np.arange(n, dtype=np.int64) - start


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles of one text, sorted; fewer words give the whole
    sequence as one shingle, none give an empty array."""
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    weights = numbers(2, k)
    if n < k:
        return mix(np.array([(words * weights[:n]).sum(dtype=U64) + U64(n)], dtype=U64))
    total = words[:n - k + 1] * weights[0]
    for j in range(1, k):
        total = total + words[j:n - k + 1 + j] * weights[j]
    return np.unique(mix(total))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``width`` words (none if the text is shorter)."""
    n = len(words)
    if n < width:
        return np.empty(0, U64)
    up = powers(BASE, n + 1)
    down = powers(U64(pow(int(BASE), -1, 1 << 64)), n + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[:n], dtype=U64)])
    return mix((total[width:] - total[:n - width + 1]) * down[:n - width + 1])
