"""MD5 of many short byte strings at once: each step of the digest is a numpy operation over all of them."""

from __future__ import annotations

import math

import numpy as np

try:  # short inputs: half the time of the one in hashlib
    from _md5 import md5
except ImportError:
    from hashlib import md5

U32 = np.uint32
BLOCK, SHORT = 64, 55  # bytes of a block, and of the longest string that fits one with its length
LANES = 8192  # strings at a time: arrays that fit the processor's cache

_SINES = [U32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURNS = [s for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turn * 4]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = [U32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By length: which bits of a block are the string's, and what follows the string."""
    kept, after = np.zeros((SHORT + 1, BLOCK), np.uint8), np.zeros((SHORT + 1, BLOCK), np.uint8)
    for n in range(SHORT + 1):
        kept[n, :n] = 255
        after[n, n] = 128
        after[n, 56:58] = (8 * n & 255, 8 * n >> 8)
    return kept.view("<u4"), after.view("<u4")


_KEPT, _AFTER = _tables()


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first of a digest's four words for each column of the 16 little-endian words of a block."""
    a, b, c, d = (np.full(words.shape[1], x, U32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_WORDS[i]]
        f += _SINES[i]
        np.left_shift(f, U32(_TURNS[i]), out=g)
        f >>= U32(32 - _TURNS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _START[0]
    return a


def md5_heads(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of each ``data[start:end]``, as one big-endian number."""
    out = np.empty(len(starts), U32)
    lengths = ends - starts
    at = np.ndarray((len(data) + 1,), f"V{BLOCK}", buffer=data + bytes(BLOCK), strides=(1,))  # a block from each byte on
    short = np.flatnonzero(lengths <= SHORT)
    for i in range(0, len(short), LANES):
        rows = short[i:i + LANES]
        blocks, n = at[starts[rows]].view("<u4").reshape(-1, 16), lengths[rows]
        blocks &= _KEPT[n]
        blocks |= _AFTER[n]
        out[rows] = _first_words(np.ascontiguousarray(blocks.T, U32)).byteswap()
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = int.from_bytes(md5(data[starts[i]:ends[i]]).digest()[:4], "big")
    return out
