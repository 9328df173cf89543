"""A rule tokenizer: words between blanks are stripped of affixes, looked up and split, by tables.

A chunk (what stands between white space) loses prefixes and suffixes one by one, and is looked up among the exceptions
each time; an address stays whole; what is left is split where an infix stands. Offsets are kept, in code
points. The tables are parameters; the default ones are for English clinical text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clinote.functions.arrow import map_arrow, slices

# Tables for English.
_OPENING = ["(", "[", "{", "<", "\"", "'", "“", "‘", "«", "*", "#", "&", "§", "%", "=", "~", "$", "£", "€", "…", ",", ";", ":", "!", "?", "—", "–"]
_CLOSING = [")", "]", "}", ">", "\"", "'", "”", "’", "»", "*", "#", "&", "%", "=", "~", "$", "£", "€", "…", ",", ";", ":", "!", "?", "—", "–"]
UNITS = ["km", "m", "cm", "mm", "mcm", "nm", "kg", "g", "mg", "mcg", "ug", "ng", "l", "dl", "ml", "mmol", "mol", "meq", "iu", "mmhg", "bpm",
         "h", "hr", "hrs", "min", "sec", "d", "wk", "yo", "kb", "mb", "gb"]
PREFIXES = [r"\.\.+", r"\+(?![0-9])", r"-(?=[A-Za-z(])", *map(re.escape, _OPENING)]
SUFFIXES = [
    r"\.\.+", r"['’][sS]", *map(re.escape, _CLOSING), r"(?<=[0-9])\+", r"(?<=[0-9])(?i:" + "|".join(UNITS) + ")",
    r"(?<=[0-9a-z%\"'”’)\]])\.", r"(?<=[A-Z][A-Z])\.",
]
INFIXES = [
    r"\.\.+", r"…", r"(?<=[0-9])[+\-*^](?=[0-9-])", r"(?<=[a-z\"'])\.(?=[A-Z\"'])", r"(?<=[^\W\d_]),(?=[^\W\d_])",
    r"(?<=[^\W\d_])(?:--?|–|—|~)(?=[^\W\d_])", r"(?<=\w)[:<>=/](?=[^\W\d_])",
]
_NEGATED = ["do", "does", "did", "is", "are", "was", "were", "has", "have", "had", "would", "could", "should", "must", "need"]
_ABBREVIATIONS = [
    "a.m.", "p.m.", "e.g.", "i.e.", "vs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "St.", "Jr.", "Sr.", "U.S.", "U.K.", "U.S.A.",
    "Ph.D.", "M.D.", "R.N.", "Inc.", "Co.", "Corp.", "Ltd.", "etc.", "approx.", "b.i.d.", "t.i.d.", "q.i.d.", "p.r.n.", "q.d.",
    "p.o.", "i.v.", "i.m.", "No.", "Jan.", "Feb.", "Mar.", "Apr.", "Jun.", "Jul.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.",
]
_SPLIT = {"cannot": ("can", "not"), "can't": ("ca", "n't"), "won't": ("wo", "n't"), "shan't": ("sha", "n't"), "gonna": ("gon", "na")}
ADDRESS = r"(?:(?:https?|ftp)://\S+|www\.\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:[\w-]+\.)+(?:com|org|net|gov|edu)(?:/\S*)?)"


def english_exceptions() -> dict[str, tuple[str, ...]]:
    """Chunks with fixed tokens, also with a capital letter first and with the other apostrophe."""
    made: dict[str, tuple[str, ...]] = {a: (a,) for a in _ABBREVIATIONS}
    made |= _SPLIT | {f"{verb}n't": (verb, "n't") for verb in _NEGATED}
    for pronoun, endings in {"i": ["'m", "'ve", "'ll", "'d"], "he": ["'ll", "'d"], "she": ["'ll", "'d"], "it": ["'ll", "'d"],
                             "we": ["'re", "'ve", "'ll", "'d"], "you": ["'re", "'ve", "'ll", "'d"], "they": ["'re", "'ve", "'ll", "'d"]}.items():
        made |= {pronoun + ending: (pronoun, ending) for ending in endings}
    made |= {chunk[0].upper() + chunk[1:]: (pieces[0][0].upper() + pieces[0][1:], *pieces[1:]) for chunk, pieces in made.items()}
    made |= {chunk.replace("'", "’"): tuple(p.replace("'", "’") for p in pieces) for chunk, pieces in made.items()}
    return made


@dataclass(frozen=True)
class Rules:
    """Patterns of affixes (a prefix is matched at the begin, a suffix at the end), exceptions and whole chunks."""

    prefixes: tuple[str, ...] = tuple(PREFIXES)
    suffixes: tuple[str, ...] = tuple(SUFFIXES)
    infixes: tuple[str, ...] = tuple(INFIXES)
    exceptions: Mapping[str, tuple[str, ...]] = field(default_factory=english_exceptions)
    whole: str | None = ADDRESS

    def __post_init__(self) -> None:
        wrong = [chunk for chunk, pieces in self.exceptions.items() if "".join(pieces) != chunk or not all(pieces)]
        if wrong:
            raise ValueError(f"the tokens of an exception must spell it: {', '.join(wrong)}")

    @cached_property
    def _compiled(self) -> tuple[re.Pattern, ...]:
        never = r"(?!)"
        return (
            re.compile("|".join(self.prefixes) or never),
            re.compile("|".join(f"(?:{s})$" for s in self.suffixes) or never),
            re.compile("|".join(self.infixes) or never),
            re.compile(self.whole or never),
        )

    def lengths(self, chunk: str) -> tuple[int, ...]:
        """Lengths of the tokens that a chunk without white space is cut into."""
        prefix, suffix, infix, whole = self._compiled
        front: list[int] = []
        back: list[int] = []
        begin, end = 0, len(chunk)
        while begin < end:
            rest = chunk[begin:end]
            if rest in self.exceptions:
                front += [len(p) for p in self.exceptions[rest]]
                begin = end
                break
            if whole.fullmatch(rest):
                # What closes a sentence behind an address is not part of it.
                closing = re.search(r"[.,;:!?)\]}>\"']+$", rest)
                if not closing:
                    front.append(len(rest))
                    begin = end
                    break
            opened = prefix.match(rest)
            if opened and opened.end():
                front.append(opened.end())
                begin += opened.end()
                continue
            closed = suffix.search(rest)
            if not closed or closed.start() == closed.end():
                break
            back.append(closed.end() - closed.start())
            end -= back[-1]
        at = begin
        for hit in infix.finditer(chunk, begin, end):
            if hit.start() > at:
                front.append(hit.start() - at)
            if hit.end() > hit.start():
                front.append(hit.end() - hit.start())
            at = hit.end()
        if at < end:
            front.append(end - at)
        return (*front, *reversed(back))


_CHUNK = re.compile(r"\S+")
_BLANK = re.compile(r"\s")
#: Chunks a worker remembers the tokens of, as offsets and as cuts.
_REMEMBERED = 200_000
_REMEMBERED_CUTS = 400_000
#: Text whose tokens a worker holds at a time.
_SLICE_BYTES = 1 << 20


def _numbers(values: array) -> pa.Array:
    return pa.array(np.frombuffer(values, np.int32), pa.int32())


def _reach(sizes: np.ndarray) -> np.ndarray:
    """Where each of the parts that lie end to end begins, and where the last one ends."""
    reach = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=reach[1:])
    return reach


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about ``_SLICE_BYTES`` characters that end before white space."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _SLICE_BYTES)
        behind = blank.start() if blank else len(text)
        yield text[at:behind]
        at = behind


class _Reader:
    def __init__(self, rules: Rules):
        self.rules, self.known = rules, {}

    def spans(self, text: str) -> tuple[array, array]:
        """Starts and ends of the tokens of a text, as 32-bit numbers."""
        starts, ends = array("i"), array("i")
        for chunk in _CHUNK.finditer(text):
            word, at = chunk.group(), chunk.start()
            lengths = self.known.get(word)
            if lengths is None:
                lengths = self.rules.lengths(word)
                if len(word) < 64 and len(self.known) < _REMEMBERED:
                    self.known[word] = lengths
            for n in lengths:
                starts.append(at)
                at += n
                ends.append(at)
        return starts, ends


class _Cuts(dict):
    """The number of the cut of each chunk, found when it is first asked for; many chunks share one.

    A cut is the bytes of each token: those of cut ``k`` begin at ``sizes[reach[k]]``.
    """

    def __init__(self, rules: Rules):
        super().__init__()
        self.rules, self.numbers, self.sizes, self.reach = rules, {}, array("i"), array("i", [0])

    def __missing__(self, chunk: str) -> int:
        cut = self.rules.lengths(chunk)
        if not chunk.isascii():
            ends = list(accumulate(cut, initial=0))
            cut = tuple(len(chunk[a:b].encode()) for a, b in pairwise(ends))
        number = self.numbers.get(cut)
        if number is None:
            self.numbers[cut] = number = len(self.numbers)
            self.sizes.extend(cut)
            self.reach.append(len(self.sizes))
        if len(chunk) < 64 and len(self) < _REMEMBERED_CUTS:
            self[chunk] = number
        return number

    def sizes_of(self, numbers: array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each of the chunks whose cuts have these numbers, and the bytes of each of these tokens."""
        asked, reach = np.frombuffer(numbers, np.int32), np.array(self.reach, np.int32)
        first, counts = reach[asked], np.diff(reach)[asked]
        before = _reach(counts)
        at = np.repeat(first - before[:-1], counts) + np.arange(before[-1], dtype=np.int32)
        sizes = np.array(self.sizes, np.int32)[at]
        if len(self.sizes) > _REMEMBERED_CUTS:  # many long chunks
            self.clear()
            self.numbers, self.sizes, self.reach = {}, array("i"), array("i", [0])
        return counts, sizes


def _token_texts(texts: pa.Array, cuts: _Cuts) -> pa.Array:
    """A list of tokens for each of the texts; null for a null text.

    Tokens are a text without its white space, so only their sizes are looked up.
    """
    data, numbers, done = [], array("i"), []
    n_chunks, behind = 0, np.zeros(len(texts) + 1, np.int32)
    for row, value in enumerate(texts, 1):
        for piece in _pieces(value.as_py() or ""):
            chunks = piece.split()
            numbers.extend(map(cuts.__getitem__, chunks))
            data.append("".join(chunks).encode())
            n_chunks += len(chunks)
            if len(piece) >= _SLICE_BYTES:  # a part of a long text
                done.append(cuts.sizes_of(numbers))
                numbers = array("i")
        behind[row] = n_chunks
    done.append(cuts.sizes_of(numbers))
    counts, sizes = (np.concatenate(parts) for parts in zip(*done))
    buffers = [None, pa.py_buffer(_reach(sizes)), pa.py_buffer(b"".join(data))]
    tokens = pa.Array.from_buffers(pa.string(), len(sizes), buffers)
    return pa.ListArray.from_arrays(pa.array(_reach(counts)[behind]), tokens, mask=texts.is_null())


def with_rule_tokens(
    df: DataFrame, text: str = "text", rules: Rules | None = None, *, as_texts: bool = False
) -> DataFrame:
    """``df`` with ``tokens``: ``start, end`` of every token in order, or its text; null for a null text."""
    kept = [f for f in df.columns if f != "tokens"]
    at = kept.index(text)
    rules = rules or Rules()

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts(rules)
        for batch in slices(batches, at, _SLICE_BYTES):
            found = _token_texts(batch.column(at), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(rules)
        for batch in slices(batches, at, _SLICE_BYTES):
            starts, ends, reach = array("i"), array("i"), array("i", [0])
            for value in batch.column(at):
                if value.is_valid:
                    first, behind = reader.spans(value.as_py())
                    starts += first
                    ends += behind
                reach.append(len(starts))
            pair = pa.StructArray.from_arrays([_numbers(starts), _numbers(ends)], names=["start", "end"])
            found = pa.ListArray.from_arrays(_numbers(reach), pair, mask=batch.column(at).is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*kept, "tokens"])

    rows = df.select(*[f"`{c}`" for c in kept])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    if as_texts:
        return map_arrow(rows, run_texts, f"{fields}, tokens array<string>")
    return map_arrow(rows, run, f"{fields}, tokens array<struct<start: int, end: int>>")


def expand_to_rule_tokens(
    df: DataFrame, text: str = "snippet", start: str = "start", end: str = "end", rules: Rules | None = None
) -> DataFrame:
    """``df`` with the span ``[start, end)`` grown to the tokens that it touches; one that touches none stays as it is."""
    columns = df.columns
    at = [columns.index(c) for c in (text, start, end)]
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(rules)
        for batch in batches:
            spans, last = [], (None, ([], []))
            for content, a, b in zip(*(batch.column(k).to_pylist() for k in at)):
                if content is None or a is None or b is None:
                    spans.append((a, b))
                    continue
                if last[0] != content:
                    last = (content, reader.spans(content))
                starts, ends = last[1]
                first, behind = bisect_right(ends, a), bisect_left(starts, b)
                spans.append((starts[first], ends[behind - 1]) if first < behind else (a, b))
            made = list(batch.columns)
            for k, values in zip(at[1:], zip(*spans) if spans else ([], [])):
                made[k] = pa.array(values, made[k].type)
            yield pa.RecordBatch.from_arrays(made, names=columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, run, fields)
