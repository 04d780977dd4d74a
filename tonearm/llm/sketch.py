"""Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017): `t` coordinates of a set in expected
O(|set| + t log t) steps."""

import numpy as np

from .text import U, mix

EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(items: np.ndarray, first: np.ndarray, t: int = 128) -> np.ndarray:
    """One row of `t` values for each set items[first[i]:first[i+1]]. In rounds 0 to t-1 every item falls in one bin by the
    round's hash; in rounds t to 2t-1 all fall in bin round - t, so every coordinate fills. A value holds its round in the
    high bits, so an earlier round always wins and a set stops after the round that filled its last bin. Two sets agree in
    a coordinate with probability about their Jaccard similarity. A set without items keeps EMPTY everywhere."""
    sets = len(first) - 1
    out = np.full((sets, t), EMPTY, U)
    flat = out.reshape(-1)
    size = np.diff(first)
    live = np.flatnonzero(size > 0)
    for r in range(t):
        if not len(live):
            return out
        if len(live) == sets:
            own, row = items, np.repeat(np.arange(sets), size)
        else:
            n = size[live]
            row = np.repeat(live, n)
            own = items[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[live], n)]
        h = mix(own, r + 1)
        cell = row * t + (h >> U(40)).astype(np.int64) % t
        np.minimum.at(flat, cell, (h & U(0xFFFFFFFFFF)) | U(r << 40))
        live = live[(out[live] == EMPTY).any(1)]
    for b in range(t):
        if not len(live):
            return out
        need = live[out[live, b] == EMPTY]
        for i in need:  # rare: a set of a few items that missed a bin in t rounds
            out[i, b] = (mix(items[first[i] : first[i + 1]], t + b + 1) & U(0xFFFFFFFFFF)).min() | U((t + b) << 40)
    return out


def band_keys(rows: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key for each `width` coordinates in turn, its place included."""
    sets, t = rows.shape
    parts = rows.reshape(sets, t // width, width)
    key = np.zeros((sets, t // width), U)
    for k in range(width):
        key = mix(key ^ parts[:, :, k], k + 1)
    return mix(key + np.arange(t // width, dtype=U) * U(0x9E3779B97F4A7C15))
