"""Sizes of many pairwise intersections of number sets, the sets being given once each."""

from __future__ import annotations

import numpy as np

COLUMNS = 8192  # numbers of a group of sets that are looked at together, one bit each
PAIRS = 4096  # pairs whose bits are compared at a time
ROWS_WORTH = 4  # pairs for each set of a group from which bits pay off


def intersections(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each pair ``a[i], b[i]`` the number of common values of these sets. Set ``j`` is ``values[at[j]:at[j + 1]]``
    without repeats. Pairs of one ``group`` are compared together: best if they share their sets."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for pairs in np.split(order, cuts) if len(order) else []:
        sets, place = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        if len(pairs) > ROWS_WORTH * len(sets):
            out[pairs] = _by_bits(values, at, sets, place[:len(pairs)], place[len(pairs):])
        else:
            for i in pairs.tolist():
                both = np.concatenate([values[at[a[i]]:at[a[i] + 1]], values[at[b[i]]:at[b[i] + 1]]])
                both.sort()
                out[i] = np.count_nonzero(both[1:] == both[:-1])
    return out


def _by_bits(values: np.ndarray, at: np.ndarray, sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``intersections`` for places ``a``, ``b`` in ``sets``: values that two sets or more hold get a bit each."""
    flat = np.concatenate([values[at[j]:at[j + 1]] for j in sets.tolist()])
    owner = np.repeat(np.arange(len(sets)), at[sets + 1] - at[sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    shared = ~(new & np.append(new[1:], True))
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    out = np.zeros(len(a), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, -(-(int(column[j - 1]) - low + 1) // 64) * 64)), bool)
        held[owner[i:j], column[i:j] - low] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for k in range(0, len(a), PAIRS):
            out[k:k + PAIRS] += np.bitwise_count(bits[a[k:k + PAIRS]] & bits[b[k:k + PAIRS]]).sum(axis=1, dtype=np.int64)
    return out
