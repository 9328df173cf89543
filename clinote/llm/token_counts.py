"""Token counts by rank-synchronous merging of ragged arrays (operator 4).

Pre-tokens of many texts lie in one array of symbols with the bounds of each sequence. In
a round, the ranks of all adjacent pairs are looked up at once, each sequence's lowest is
found, and all sequences apply theirs together; a sequence without a pair is finished and
its surviving symbols are counted. No token is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from clinote.llm.pieces import PieceStore, group_sums
from clinote.llm.tables import KeyTable, pair_keys, ranges
from clinote.llm.workers import map_batches, slices

BLANK = "▁"  # stands for a blank in the vocabulary
_NONE = np.int32(2**31 - 1)
_BLOCK = 1 << 14


class MergeRanks:
    """Symbols, the ranks of pairs of them, and the tokens a surviving symbol counts as."""

    def __init__(self, pieces: dict[str, float]):
        """``pieces`` are the texts of the vocabulary with their scores; the highest merges first.

        A character outside the vocabulary counts as its UTF-8 bytes.
        """
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece reaches over a blank, so texts cannot be split there")
        symbols = {p: i for i, p in enumerate(pieces)}
        for piece in pieces:
            for char in piece:
                symbols.setdefault(char, len(symbols))
        rank_of = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: -pieces[p]))}
        keys, ranks, made = [], [], []
        for piece, rank in rank_of.items():
            for at in range(1, len(piece)):
                if (left := symbols.get(piece[:at])) is not None and (right := symbols.get(piece[at:])) is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
                    made.append(symbols[piece])
        self._rank = KeyTable(np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.int32), int(_NONE))
        self._made = np.zeros(len(pieces), dtype=np.int32)
        self._made[ranks] = made
        points = np.array([ord(s) for s in symbols if len(s) == 1], dtype=np.uint64)
        chars = np.array([i for s, i in symbols.items() if len(s) == 1], dtype=np.int32)
        self._of_char = KeyTable(points, chars, -1)
        self._tokens = np.array([1 if s in pieces else len(s.encode()) for s in symbols], dtype=np.int64)

    @classmethod
    def from_file(cls, path: str) -> MergeRanks:
        """From a sentencepiece BPE model with byte fallback."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a symbol of -1 is in no pair."""
        known = (left >= 0) & (right >= 0)
        out = np.full(len(left), _NONE, dtype=np.int32)
        out[known] = self._rank.get(pair_keys(left[known], right[known]))
        return out

    def count(self, words: Sequence[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        parts = [self._count_block(words[i:i + _BLOCK]) for i in range(0, len(words), _BLOCK)]
        return np.concatenate([np.empty(0, dtype=np.int64), *parts])

    def _count_block(self, words: Sequence[str]) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self._of_char.get(points)
        owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        # Characters outside the vocabulary are never merged; their bytes count.
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        totals = np.bincount(owner, np.where(symbols < 0, width, 0), len(words)).astype(np.int64)
        while len(symbols):
            last = np.append(owner[1:] != owner[:-1], True)
            rank = np.full(len(symbols), _NONE, dtype=np.int32)
            inner = np.flatnonzero(~last)
            rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
            firsts = np.flatnonzero(np.append(True, last[:-1]))
            lowest = np.minimum.reduceat(rank, firsts)
            sizes = np.diff(np.append(firsts, len(symbols)))
            low = np.repeat(lowest, sizes)
            done = (low == _NONE) & (symbols >= 0)
            totals += np.bincount(owner[done], self._tokens[symbols[done]], len(words)).astype(np.int64)
            at = self._to_merge(symbols, owner, rank, low)
            symbols, keep = symbols.copy(), low != _NONE
            symbols[at] = self._made[rank[at]]
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return totals

    def _to_merge(self, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places where each sequence applies its lowest pair.

        All of them at once where that makes no new pair of a lower rank, else the first alone.
        """
        at = np.flatnonzero((rank == low) & (rank != _NONE))
        if not len(at):
            return at
        # In a run of touching places every other one merges, from the left.
        opens = np.append(True, np.diff(at) != 1)
        number = ranges(np.zeros(int(opens.sum()), dtype=np.int64), np.diff(np.append(np.flatnonzero(opens), len(at))))
        at = at[number % 2 == 0]
        if len(at) == len(np.unique(owner[at])):
            return at
        made = np.full(len(symbols), -1, dtype=np.int32)
        made[at] = self._made[rank[at]]
        padded, owners = np.append(symbols, [-1, -1]), np.append(owner, [-1, -1])
        follows = self._ranks(made[at], np.where(owners[at + 2] == owner[at], padded[at + 2], -1))
        left = np.where(np.append([-1, -1], made)[at] >= 0, np.append([-1, -1], made)[at], np.append(-1, symbols)[at])
        left = np.where(np.append(-1, owner)[at] == owner[at], left, -1)
        precedes = self._ranks(left.astype(np.int32), made[at])
        unsafe = np.zeros(int(owner[-1]) + 1, dtype=bool)
        unsafe[owner[at[np.minimum(follows, precedes) < rank[at]]]] = True
        is_first = np.append(True, owner[at][1:] != owner[at][:-1])
        return at[is_first | ~unsafe[owner[at]]]


class Counter:
    """Counts the tokens of batches of texts; each distinct pre-token is merged once."""

    def __init__(self, ranks: MergeRanks, max_known: int = 400_000):
        self._ranks = ranks
        self._words = regex.compile(f"{BLANK}+[^{BLANK}]*")
        self._store = PieceStore(self._count, max_known)

    def _count(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ranks.count([BLANK + p for p in pieces]), np.ones(len(pieces), dtype=np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty and has none."""
        texts = pc.fill_null(texts, "")
        # A pre-token is a run of blanks with what follows; a text starts with one blank more.
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  |\x00"), pc.match_substring(texts, BLANK))
        odd = odd.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = group_sums(self._store.values(split.values)[0], np.diff(split.offsets.to_numpy()))
        words, sizes = [], []
        for text in texts.filter(pa.array(odd)).to_pylist():
            cut = self._words.findall(BLANK + text.replace(" ", BLANK))
            words += cut
            sizes.append(len(cut))
        counts[odd] = group_sums(self._ranks.count(words), np.array(sizes, dtype=np.int64))
        counts[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        return counts


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker and file; the pre-tokens it knows serve later tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(MergeRanks.from_file(path))
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row, by the sentencepiece BPE model at ``path``.

    Null text is empty: 0 bytes, 0 tokens. Rows are mapped one by one, so repeated rows and
    null keys stay as they are; further columns are left out. The model file is read where
    the work runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in slices(batches, "text"):
            counts = tokens.count(batch.column(1))
            sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array(counts > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean"
    return map_batches(df.select(key, df[text].alias("text")), run, schema)
