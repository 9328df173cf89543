"""Hashed words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clinote.llm.tables import ranges

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
_BASE = np.uint64(0x100000001B3)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 256), _BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more)
    return _POWERS[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def weights(n: int) -> np.ndarray:
    """Odd factors by which the places of a window count in its hash."""
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64)))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (no nulls) one after the other, and the number of bytes of each."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts), np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], np.diff(bounds)


def spans_hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans (none empty) of bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = ranges(np.zeros(len(lengths), np.int64), lengths)
    weighed = data[ranges(starts, lengths)].astype(np.uint64) * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(weighed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def words_between_blanks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts in which blanks alone part words: bytes, starts, lengths, number of words per text."""
    data, sizes = utf8(texts)
    ends_of_texts = np.cumsum(sizes)
    solid = np.append(data != 32, False)
    before = np.append(False, solid[:-1])[:len(solid)]
    before[(ends_of_texts - sizes)] = False  # a text begins anew
    starts = np.flatnonzero(solid & ~before)
    after = np.append(solid[1:], False)
    after[(ends_of_texts - 1)[sizes > 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    return data, starts, ends - starts, counts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (runs of letters and digits) of all texts, and their number per text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD, " ")
    data, starts, lengths, counts = words_between_blanks(plain)
    return spans_hashed(data, starts, lengths), counts


def shingles(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of all texts, ascending within each, and their number per text.

    A shingle is ``words`` words in a row. A text of fewer words is one shingle, and one without
    words has none. At most 65,536 texts.
    """
    hashes, counts = word_hashes(texts)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    first = ranges(starts, sizes)
    owner = np.repeat(np.arange(len(counts)), sizes)
    last = (starts + counts)[owner]
    combined, weight = np.zeros(len(first), np.uint64), weights(words)
    for k in range(words):
        inside = first + k < last
        combined[inside] += hashes[first[inside] + k] * weight[k]
    keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (mix(combined) >> np.uint64(16)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    owner = (keys >> np.uint64(48)).astype(np.int64)
    return keys & np.uint64((1 << 48) - 1), np.bincount(owner, minlength=len(counts)).astype(np.int64)
