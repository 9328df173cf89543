"""Ids of the pieces of texts, each distinct piece encoded once.

Texts repeat their words: pieces between blanks are made distinct per batch, looked up
among those a worker has met, and only new ones are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clinote.llm.tables import ranges

#: Any white space, also outside ASCII, twice in a row.
GAP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"


class PieceStore:
    """Encoded pieces; ``encode`` gives flat values and the number of values of each new piece."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_known: int = 1_000_000):
        self._encode, self._max_known = encode, max_known
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._flat = np.empty(0, dtype=np.int32)
        self._starts = np.empty(0, dtype=np.int64)
        self._counts = np.empty(0, dtype=np.int64)

    def _places(self, distinct: list[str]) -> np.ndarray:
        known = self._known
        new = [p for p in distinct if p not in known]
        if len(known) + len(new) > self._max_known:  # a bound on memory: begin again
            self._forget()
            known, new = self._known, distinct
        if new:
            flat, counts = self._encode(new)
            starts = np.cumsum(counts) - counts + len(self._flat)
            for number, piece in enumerate(new, start=len(known)):
                known[piece] = number
            self._flat = np.concatenate([self._flat, flat.astype(np.int32)])
            self._starts = np.concatenate([self._starts, starts])
            self._counts = np.concatenate([self._counts, counts])
        return np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def counts(self, pieces: pa.Array) -> np.ndarray:
        """Number of values of each piece."""
        return self._counts[self._of(pieces)]

    def values(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Values of all pieces one after the other, and their number for each piece."""
        places = self._of(pieces)
        counts = self._counts[places]
        return self._flat[ranges(self._starts[places], counts)], counts

    def _of(self, pieces: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(pieces)
        return self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]


def group_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(values)])[np.cumsum(sizes)]
    return np.diff(ends, prepend=0)
