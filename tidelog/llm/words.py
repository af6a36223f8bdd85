"""Words of many texts at once, as numpy arrays of 64-bit hashes over the texts' UTF-8 bytes."""

from __future__ import annotations

import functools

import numpy as np

#: White space of the contracts: space and the controls from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, back):
        p = np.empty(n, np.uint64)
        p[0], done = 1, 1
        while done < n:
            more = min(done, n - done)
            p[done : done + more] = p[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, for at least n places."""
    return _powers(1 << max(16, int(n).bit_length()))


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """h with which (h[b] - h[a]) * inverse[a] is the hash of flat[a:b]."""
    up, _ = powers(len(flat) + 1)
    h = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=h[1:])
    return h


def words(flat: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of every word, in order; rows are those of offsets, and words end with their row."""
    if lower:
        flat = _LOWER[flat]
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = ~_SPACE[flat]
    edge = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    both = cuts[inside[cuts] & inside[cuts + 1]]  # a row's end between two bytes of words
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, np.repeat(np.unique(both), 2)]))
    start, end = at[::2], at[1::2]
    _, down = powers(len(flat) + 1)
    h = prefix_hash(flat)
    hashed = mixed((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))
    return start, end, np.searchsorted(offsets, start, "right") - 1, hashed
