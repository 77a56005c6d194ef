"""Suffix arrays by prefix refinement and their common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

_LANES = 8192


def packed(text: np.ndarray, pad: int = 72) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros beyond the end; pad places more."""
    raw = np.concatenate([text, np.zeros(pad + 8, np.uint8)])
    return np.ndarray((len(text) + pad,), ">u8", raw.data, 0, (1,)).astype(np.uint64)


def suffix_array(words: np.ndarray, n: int) -> np.ndarray:
    """Places 0..n-1 in order of their suffixes; words is packed(text).

    Larsson and Sadakane's refinement: places are grouped by their first 8 bytes; then only groups of more than one place
    are sorted again, by the group of the place h further on, and h doubles.
    """
    order = np.argsort(words[:n])
    key = words[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = group + 1  # 0: beyond the end
    h = 8
    while h < n:
        size = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            break
        at = order[open_]
        own, after = group[open_], rank[np.minimum(at + h, n)]
        inner = np.argsort((own.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))
        at, after = at[inner], after[inner]
        order[open_] = at
        new[open_[1:]] |= after[1:] != after[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = group[open_] + 1
        h *= 2
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each entry of order its common prefix with the entry before it, up to most bytes. The order must be whole.

    Kasai's pass over the text, a place's prefix being at least its predecessor's less one; many lanes of the text at once.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lanes = min(_LANES, n)
    begin = (np.arange(lanes + 1) * n) // lanes
    at, end = begin[:-1].copy(), begin[1:]
    h = np.zeros(lanes, np.int64)
    while True:
        live = np.flatnonzero(at < end)
        if not len(live):
            return out
        i = at[live]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        have = np.where(r > 0, np.maximum(h[live] - 1, 0), most)
        busy = np.flatnonzero(have < most)
        while len(busy):
            apart = words[i[busy] + have[busy]] ^ words[j[busy] + have[busy]]
            same = _leading_bytes(apart)
            have[busy] += same
            busy = busy[(same == 8) & (have[busy] < most)]
        have = np.where(r > 0, np.minimum(have, most), 0)
        out[r] = have
        h[live] = have
        at[live] += 1


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of each number are zero."""
    out = np.zeros(len(x), np.int64)
    for step, shift in ((4, 32), (2, 48), (1, 56)):
        zero = (x >> np.uint64(shift)) == 0
        out += zero * step
        x = np.where(zero, x << np.uint64(8 * step), x)
    return out + (x == 0)
