"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""
from __future__ import annotations

import numpy as np

_BYTE_STEPS = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def eight_bytes(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes at every place as one big-endian number; zeros follow the data, ``more`` places of them are kept."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)]).astype(np.uint64)
    n = len(data) + more
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + n]
    return out


def suffix_array(first: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the place of each in it; ``first`` orders them by their first ``known`` symbols.

    Groups of suffixes that are equal so far are refined by the rank of the suffix ``known`` symbols further, and ``known`` doubles; what stands alone in its group is
    never touched again.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = first[order][1:] != first[order][:-1]
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(fresh, at, 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    alone = fresh & np.append(fresh[1:], True)
    open_ = np.flatnonzero(~alone)
    while len(open_):
        suffix = order[open_]
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + known, n)] + 1)
        turn = np.argsort(key, kind="stable")
        suffix, key = suffix[turn], key[turn]
        order[open_] = suffix
        fresh = np.ones(len(open_), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[suffix] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        known *= 2
    place = rank[:n]
    return order, place


def common_prefixes(eight: np.ndarray, order: np.ndarray, place: np.ndarray, lanes: np.ndarray, lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Common prefix of each suffix with the one before it in the order, up to ``most``.

    Kasai's method runs along the text, as a suffix loses at most one symbol against the one before. Here it runs along many stretches at once, ``lengths`` places from each of
    ``lanes``, eight bytes at a time; ``out[t]`` has the values of the lanes longer than ``t``, in the order of ``lanes``.
    """
    out, last = [], len(eight) - 1
    common = np.zeros(len(lanes), np.int64)
    for t in range(int(lengths.max()) if len(lengths) else 0):
        alive = np.flatnonzero(lengths > t)
        here = lanes[alive] + t
        rank = place[here]
        other = order[rank - 1]
        h = np.maximum(common[alive] - 1, 0)
        h[rank == 0] = 0
        going = np.flatnonzero(rank > 0)
        while len(going):
            x = eight[np.minimum(here[going] + h[going], last)] ^ eight[np.minimum(other[going] + h[going], last)]
            same = x == 0
            h[going] += 8 - np.searchsorted(_BYTE_STEPS, x, side="right")
            going = going[same & (h[going] < most)]
        common[alive] = np.minimum(h, most)
        out.append(common[alive].copy())
    return out
