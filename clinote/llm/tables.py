"""Look-up tables and ragged arrays in numpy."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Unsigned 64-bit keys to values, looked up for whole arrays; absent keys give ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.missing = missing
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self._mask, self._shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self._keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self._values = np.full(1 << bits, missing, dtype=np.asarray(values).dtype)
        keys, values = keys.astype(np.uint64), np.asarray(values)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] == _EMPTY
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = np.zeros(len(slot), dtype=bool)
            placed[first] = True
            placed &= free
            self._keys[slot[placed]], self._values[slot[placed]] = keys[placed], values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        held = self._keys[slot]
        out = np.where(held == keys, self._values[slot], self._values.dtype.type(self.missing))
        open_ = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            held = self._keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self._values[slot[open_[same]]]
            open_ = open_[~same & (held != _EMPTY)]
        return out


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``start .. start + length - 1``, one range after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths)
