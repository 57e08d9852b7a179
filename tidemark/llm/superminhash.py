"""SuperMinHash signatures of many sets at once.

Element by element the method draws a random permutation of the m slots, step by step: at step j it puts j + r (0 <= r < 1)
in the slot that the permutation names there, and each slot keeps its least value. A value of step j is at least j, so no
further step is needed once every slot holds less than j + 1. Here step j is made for all elements of all unfinished sets
together, which gives the same signature, since a minimum doesn't mind the order.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.words import mixed

STEP = 0xD1342543DE82EF95


def draws(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For step j: the value j + r as a fixed-point number, and the place, from j on, that is swapped with place j."""
    bits = mixed(elements + np.uint64(STEP * (j + 1) % (1 << 64)))
    value = (np.uint64(j) << np.uint64(32)) | (bits >> np.uint64(32))
    place = j + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
    return value, place


def signatures(elements: np.ndarray, of: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Of `sets` sets, one row of m numbers each; `of` names each element's set. Empty sets keep the largest number in all slots."""
    out = np.full(sets * m, np.iinfo(np.uint64).max, np.uint64)
    value, place = draws(elements, 0, m)
    np.minimum.at(out, of * m + place, value)
    sizes = np.bincount(of, minlength=sets)
    open_ = (out.reshape(sets, m).max(1) >> np.uint64(32) > 0) & (sizes > 0)
    left = open_[of]
    elements, of, place = elements[left], of[left], place[left]
    permutation = np.empty((len(elements), m), np.uint8 if m <= 256 else np.int32)
    permutation[:] = np.arange(m)
    rows = np.arange(len(elements))
    for j in range(m):
        if not len(elements):
            break
        if j:
            value, place = draws(elements, j, m)
        taken = permutation[rows, place]
        permutation[rows, place] = permutation[rows, j]
        permutation[rows, j] = taken
        if j:
            np.minimum.at(out, of * m + taken, value)
            open_ = (out.reshape(sets, m).max(1) >> np.uint64(32) > j) & (sizes > 0)
            left = open_[of]
            if left.sum() < 0.7 * len(left):
                elements, of, permutation = elements[left], of[left], permutation[left]
                rows = np.arange(len(elements))
            elif not left.any():
                break
    return out.reshape(sets, m)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets, told from their signatures."""
    return float((a == b).mean())
