"""BPE encoding and decoding with an automaton compiled from the merge list (operator 3).

The automaton reads tokens. It starts as one state that reads every base symbol and is
changed by one gadget per merge, in rank order. The gadget of ``a + b -> c`` splits off
the state behind ``a`` without the arc ``b``, and adds the arc ``c`` beside every arc
``a`` that could be followed by ``b``: after all gadgets the automaton accepts exactly the
token sequences that the merges leave unchanged, and is deterministic. A gadget changes
one arc and adds one state and one label; everything else is inherited:

* the state behind ``c`` has the arcs that the state behind ``b`` had before the gadget,
* the states that read ``c`` are those that read ``a`` before the gadget,
* the state behind ``a`` loses the arc ``b`` (and, if ``a = b``, never gets the arc ``c``,
  as the leftmost pair merges first).

So the arc table is stored as these edits: per token what it inherits from and when, and
the time at which an arc was cut. A word is encoded by moving along its bytes and taking,
at each position, the one arc that ends there and starts in the state reached at its
start. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from clinote.llm.pieces import GAP, PieceStore, group_sums
from clinote.llm.tables import KeyTable, pair_keys, ranges
from clinote.llm.workers import map_batches, slices

#: The pre-split pattern of byte-level BPE vocabularies of this kind.
PRE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NEVER = np.int32(2**31 - 1)
_START, _NOWHERE = -1, -2
_BYTES = np.uint64(256)
_BLOCK = 1 << 14


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class MergeAutomaton:
    """Compiled merges: arcs as inherited edits, a byte trie over the labels, the labels."""

    def __init__(self, labels: Sequence[bytes], merges: Sequence[tuple[int, int, int]], special: dict[str, int]):
        """``labels[id]`` are a token's bytes; ``merges`` are ``(left, right, merged)`` ids by rank."""
        self.labels, self.special = list(labels), dict(special)
        size = len(labels)
        self.born = np.zeros(size, dtype=np.int32)
        self.out_from = np.arange(size, dtype=np.int32)  # the token whose state a state copies
        self.in_from = np.arange(size, dtype=np.int32)  # the token beside whose arcs an arc was added
        cut: dict[tuple[int, int], int] = {}
        known = {i for i, label in enumerate(labels) if len(label) == 1}
        for time, (left, right, merged) in enumerate(merges, start=1):
            if left not in known or right not in known or merged in known:
                raise ValueError(f"merge {time} uses a symbol that is not made yet, or makes one again")
            known.add(merged)
            self.born[merged], self.out_from[merged], self.in_from[merged] = time, right, left
            cut.setdefault((left, right), time)
            if left == right:
                cut.setdefault((left, merged), time)
        pairs = np.array(list(cut), dtype=np.int64).reshape(-1, 2)
        self._cut = KeyTable(
            pair_keys(pairs[:, 0], pairs[:, 1]), np.array(list(cut.values()), dtype=np.int32), int(_NEVER)
        )
        self._build_trie(sorted(known))

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        """From a tokenizer file of a byte-level BPE model."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, symbols = spec["model"]["vocab"], byte_symbols()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocabulary.values(), *added.values()]) + 1
        of_symbol = {s: bytes([b]) for b, s in enumerate(symbols)}
        labels = [b""] * size
        for token, i in vocabulary.items():
            if token not in added:
                labels[i] = b"".join(of_symbol[c] for c in token)
        for token, i in added.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        return cls(labels, merges, added)

    def _build_trie(self, tokens: list[int]) -> None:
        """Nodes are prefixes of labels, so that all arcs from a position are found byte by byte."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int, int]] = []
        token_at = [-1]
        for token in sorted(tokens, key=lambda t: len(self.labels[t])):
            label, node = self.labels[token], 0
            for end in range(1, len(label) + 1):
                if (child := nodes.get(label[:end])) is None:
                    child = nodes[label[:end]] = len(nodes)
                    edges.append((node, label[end - 1], child))
                    token_at.append(-1)
                node = child
            token_at[node] = token
        table = np.array(edges, dtype=np.int64).reshape(-1, 3)
        self._next = KeyTable(table[:, 0] * 256 + table[:, 1], table[:, 2].astype(np.int32), -1)
        self._first_node = self._next.get(np.arange(256))
        self._token_at = np.array(token_at, dtype=np.int32)
        self._sizes = np.array([len(label) for label in self.labels], dtype=np.int64)

    def has_arc(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the state behind each token of ``states`` (-1: the start) reads each of ``tokens``."""
        arc = np.ones(len(tokens), dtype=bool)
        rows = np.flatnonzero(states >= 0)
        state, token = states[rows], tokens[rows]
        time = np.full(len(rows), _NEVER, dtype=np.int32)
        while len(rows):
            whole = self._cut.get(pair_keys(state, token)) >= time
            arc[rows[~whole]] = False
            state_born, token_born = self.born[state], self.born[token]
            goes_on = whole & ((state_born > 0) | (token_born > 0))
            rows, state, token = rows[goes_on], state[goes_on], token[goes_on]
            state_born, token_born = state_born[goes_on], token_born[goes_on]
            time = np.maximum(state_born, token_born)
            state = np.where(state_born == time, self.out_from[state], state)
            token = np.where(token_born == time, self.in_from[token], token)
        return arc

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and the number of ids of each word."""
        parts = [self._encode_block(words[i:i + _BLOCK]) for i in range(0, len(words), _BLOCK)]
        if not parts:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _encode_block(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        word_ends = np.cumsum(lengths)
        ends = np.repeat(word_ends, lengths).astype(np.int32)
        offset = ranges(np.zeros(len(lengths), dtype=np.int64), lengths).astype(np.int32)
        # All labels from all positions: (start, length, token), by walking the trie.
        at, depth = np.arange(len(data), dtype=np.int32), 1
        node, found = self._first_node[data], []
        at, node = at[node >= 0], node[node >= 0]
        while len(at):
            token = self._token_at[node]
            hit = token >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth, dtype=np.int32), token[hit]))
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
            node = self._next.get(node.astype(np.uint64) * _BYTES + data[at + depth].astype(np.uint64))
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
        if not found:
            return np.empty(0, dtype=np.int32), lengths
        start, length, token = (np.concatenate(part) for part in zip(*found))
        # Move all words forward together, by the position at which an arc ends.
        step = offset[start] + length
        order = np.argsort(step.astype(np.uint16) if len(data) < 1 << 16 or step.max() < 1 << 16 else step, kind="stable")
        start, length, token, step = start[order], length[order], token[order], step[order]
        bounds = np.flatnonzero(np.diff(step)) + 1
        reached = np.full(len(data), _NOWHERE, dtype=np.int32)  # the arc that ends with each byte
        for low, high in zip([0, *bounds], [*bounds, len(step)]):
            s, t, n = start[low:high], token[low:high], length[low:high]
            before = np.where(offset[s] > 0, reached[s - 1], _START)
            taken = self.has_arc(before, t)
            reached[s[taken] + n[taken] - 1] = t[taken]
        # Back along the arcs taken.
        last, marked = word_ends[lengths > 0] - 1, np.zeros(len(data) + 1, dtype=bool)
        while len(last):
            marked[last] = True
            before = last - self._sizes[reached[last]]
            last = before[before >= last - offset[last]]
        counts = np.add.reduceat(marked, word_ends - lengths, dtype=np.int64) * (lengths > 0)
        return reached[marked[:-1]], counts

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, as text; bytes that are not UTF-8 become the replacement character."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class Encoder:
    """Encodes batches of texts; each distinct piece between lone blanks is encoded once."""

    def __init__(self, automaton: MergeAutomaton, max_known: int = 400_000):
        self.automaton = automaton
        self._pre_split = regex.compile(PRE_SPLIT)
        self._special = regex.compile("|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True)))) \
            if automaton.special else None
        self._inner = PieceStore(lambda pieces: self._encode_pieces([" " + p for p in pieces]), max_known)
        self._first = PieceStore(self._encode_pieces, max_known // 10)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[str, int] = {}
        cut = [[words.setdefault(w, len(words)) for w in self._pre_split.findall(p)] for p in pieces]
        ids, counts = self.automaton.encode_words([w.encode() for w in words])
        places = np.array([n for numbers in cut for n in numbers], dtype=np.int64)
        flat = ids[ranges((np.cumsum(counts) - counts)[places], counts[places])]
        return flat, group_sums(counts[places], np.array([len(numbers) for numbers in cut], dtype=np.int64))

    def _encode_odd(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special tokens or with white space in a row: flat ids and counts."""
        plain, specials, sizes = [], [], []
        for text in texts:
            at, before = 0, len(plain)
            for hit in self._special.finditer(text) if self._special else ():
                plain.append(text[at:hit.start()])
                specials.append(self.automaton.special[hit.group()])
                at = hit.end()
            plain.append(text[at:])
            specials.append(_START)  # the end of the text: no id
            sizes.append(len(plain) - before)
        flat, counts = self._encode_pieces(plain)
        closing = np.array(specials, dtype=np.int32)
        ids = np.insert(flat, np.cumsum(counts), closing)
        ends = np.cumsum(counts + 1) - 1
        is_end = np.zeros(len(ids), dtype=bool)
        is_end[ends[closing == _START]] = True
        return ids[~is_end], group_sums(counts + (closing != _START), np.array(sizes, dtype=np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number for each text; null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, GAP)
        for token in self.automaton.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        # A lone blank starts a new piece: no pre-split word reaches over it.
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        pieces, offsets = split.values, split.offsets.to_numpy().astype(np.int64)
        sizes, firsts = np.diff(offsets), offsets[:-1]
        is_first = np.zeros(len(pieces), dtype=bool)
        is_first[firsts] = True
        first, first_counts = self._first.values(pieces.filter(pa.array(is_first)))
        inner, inner_counts = self._inner.values(pieces.filter(pa.array(~is_first)))
        inner_counts = group_sums(inner_counts, sizes - 1)
        odd_ids, odd_counts = self._encode_odd(texts.filter(pa.array(odd)).to_pylist())
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = first_counts + inner_counts
        counts[odd] = odd_counts
        flat, starts = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        flat[ranges(starts[~odd], first_counts)] = first
        flat[ranges(starts[~odd] + first_counts, inner_counts)] = inner
        flat[ranges(starts[odd], odd_counts)] = odd_ids
        return flat, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; the pieces it knows serve later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(MergeAutomaton.from_file(path))
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of every text; the vocabulary file is read where the work runs.

    Null text is empty and gives no ids. Rows are mapped one by one: repeated rows, null
    keys and further columns need no care (the latter are left out).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches, "text"):
            flat, counts = coder.encode(batch.column(1))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return map_batches(_keyed(df, key, text), run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode(df: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ``key, ids``; null ids are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = encoder(path).automaton
        for batch in batches:
            decoded = [automaton.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=[key, "text"])

    return map_batches(df.select(key, "ids"), run, f"`{key}` {dict(df.dtypes)[key]}, text string")


def round_trip(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``key, n_tokens, ids_sha256, decoded_sha256`` per row.

    The same as ``encode`` then ``decode``, without moving the ids out of the worker.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        names = [str(i) for i in range(len(coder.automaton.labels))]
        for batch in slices(batches, "text"):
            of_ids, of_text = [], []
            flat, counts = coder.encode(batch.column(1))
            for ids in np.split(flat, np.cumsum(counts)[:-1]):
                listed = ids.tolist()
                of_ids.append(hashlib.sha256(",".join([names[i] for i in listed]).encode()).hexdigest())
                of_text.append(hashlib.sha256(coder.automaton.decode(listed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(_keyed(df, key, text), run, schema)


def encode_checked(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids, is_lossless``: the ids, and whether decoding them gives the text back.

    ``ids`` are raw little-endian 32-bit numbers; null text is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches, "text"):
            flat, counts = coder.encode(batch.column(1))
            rows = np.split(flat, np.cumsum(counts)[:-1])
            same = [coder.automaton.decode(ids.tolist()) == (t or "") for ids, t in zip(rows, batch.column(1).to_pylist())]
            raw = pa.array([ids.astype("<u4").tobytes() for ids in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), raw, pa.array(same, pa.bool_())],
                names=[key, "n_tokens", "ids", "is_lossless"],
            )

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids binary, is_lossless boolean"
    return map_batches(_keyed(df, key, text), run, schema)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, df[text].alias("text"))
