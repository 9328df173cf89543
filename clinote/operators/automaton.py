"""Dictionary tagging with a failure-link automaton over words, compiled once per lexicon.

The words of the terms, and what stands between them, are the alphabet. States, moves, failure links and the
terms that end in a state are flat arrays, so a lexicon of millions of terms is some tens of megabytes that every task
reads once. Text is scanned where it was read: nothing of it is shuffled, whatever the size of the
lexicon. A batch of notes is cut into lanes of equally many words that all move one word at a
time; a lane reads on for as many words as the longest term has, so no term is lost at its end.

The mentions are those of ``tagger.tag``.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clinote.functions.arrow import map_arrow
from clinote.operators import tagger
from clinote.operators.tagger import GAP, WORD

#: A compiled lexicon travels to every task, so its size is bounded; beyond it ``tagger.tag`` joins.
MAX_TERMS, MAX_BYTES = 4_000_000, 512 << 20
LANE_WORDS, SLICE_WORDS = 128, 1 << 21
ALL, LONGEST = "all", "leftmost_longest"
_PIECE = f"{WORD}+|{GAP}+"


@dataclasses.dataclass(frozen=True)
class Automaton:
    """``moves`` (sorted ``state * width + word``) lead to ``targets``; ``fail`` and ``shorter`` are the failure link
    and the next state on that way in which a term ends; the terms of a state are ``first[state]:first[state + 1]``."""

    words: pa.Array
    moves: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    shorter: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    concepts: np.ndarray
    terms: pa.Array
    leads: list[str]
    tails: list[str]

    @property
    def version(self) -> str:
        """A digest of the lexicon: equal lexicons give equal versions in whatever order their rows come."""
        made = hashlib.sha256()
        for part in (self.moves, self.targets, self.first, self.concepts):
            made.update(part.tobytes())
        for texts in (self.words.to_pylist(), self.terms.to_pylist(), self.leads, self.tails):
            made.update("\x00".join(texts).encode() + b"\x01")
        return made.hexdigest()

    def next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; an unknown word (negative) leads to the start."""
        out = np.zeros(len(state), dtype=np.int64)
        lanes = np.flatnonzero(word >= 0)
        held = state[lanes]
        while len(lanes):
            key = held * len(self.words) + word[lanes]
            at = np.searchsorted(self.moves, key)
            at[at == len(self.moves)] = 0
            found = self.moves[at] == key
            out[lanes[found]] = self.targets[at[found]]
            on = ~found & (held != 0)
            lanes, held = lanes[on], self.fail[held[on]]
        return out


def _link(moves: np.ndarray, targets: np.ndarray, width: int, parent: np.ndarray, word: np.ndarray,
          levels: list[tuple[int, int]]) -> np.ndarray:
    """Failure links, level by level: where the parent's link leads by the same word."""
    fail = np.zeros(len(parent), dtype=np.int64)
    for low, high in levels[1:]:
        states = np.arange(low, high)
        held = fail[parent[states]]
        while len(states):
            key = held * width + word[states]
            at = np.searchsorted(moves, key)
            at[at == len(moves)] = 0
            found = moves[at] == key
            fail[states[found]] = targets[at[found]]
            on = ~found & (held != 0)
            states, held = states[on], fail[held[on]]
    return fail


def compile_lexicon(lexicon: DataFrame) -> Automaton:
    """The automaton of ``concept_id, term`` rows; ValueError beyond ``MAX_TERMS`` or ``MAX_BYTES``.

    Terms without a letter or digit, and null ones, cannot be looked up (``tagger.unusable_terms``).
    """
    pieces = F.regexp_extract_all("loose_term", F.lit(_PIECE), F.lit(0))
    terms = tagger._terms(lexicon).select("concept_id", "term", "lead", "tail", pieces.alias("pieces"))
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    if size["n"] > MAX_TERMS or (size["bytes"] or 0) > MAX_BYTES:
        raise ValueError(f"{size['n']} terms are too many for one automaton; use tagger.tag")
    table = terms.orderBy("pieces", "concept_id", "term", "lead", "tail").toArrow().combine_chunks()
    lists = table.column("pieces").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.string()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    coded = lists.flatten().dictionary_encode()
    words, flat = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    starts, width = np.cumsum(lengths) - lengths, max(1, len(words))
    state = np.zeros(len(lengths), dtype=np.int64)
    moves, parents, by, depths, levels, n = [], [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)], [], 1
    for step in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths > step)
        keys, place = np.unique(state[rows] * width + flat[starts[rows] + step], return_inverse=True)
        state[rows] = n + place
        moves.append(keys)
        parents.append(keys // width)
        by.append(keys % width)
        depths.append(np.full(len(keys), step + 1))
        levels.append((n, n + len(keys)))
        n += len(keys)
    # States are numbered in the order of their moves, as parents come before children.
    keys = np.concatenate(moves) if moves else np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    parent, word, depth = np.concatenate(parents), np.concatenate(by), np.concatenate(depths)
    keys, targets = keys[order], order + 1
    if not len(keys):
        keys, targets = np.array([-1]), np.array([0])
    fail = _link(keys, targets, width, parent, word, levels) if levels else np.zeros(1, np.int64)
    by_state = np.argsort(state, kind="stable")
    first = np.append(0, np.cumsum(np.bincount(state, minlength=n)))
    ends = np.diff(first) > 0
    shorter = np.zeros(n, dtype=np.int64)
    for low, high in levels:
        linked = fail[low:high]
        shorter[low:high] = np.where(ends[linked], linked, shorter[linked])
    chosen = table.take(pa.array(by_state))
    text = lambda name: pa.array(chosen.column(name).to_pylist(), pa.string())
    return Automaton(
        words, keys, targets, fail, shorter, depth, first, chosen.column("concept_id").to_numpy().astype(np.int64),
        text("term"), text("lead").to_pylist(), text("tail").to_pylist(),
    )


def _ends(made: Automaton, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and state of every end of a term in a row of words, from lanes that move together."""
    longest = int(made.depth.max())
    lane = max(LANE_WORDS, 4 * longest)
    n_lanes = -(-len(words) // lane)
    padded = np.full(n_lanes * lane + longest, -1, dtype=np.int64)
    padded[:len(words)] = words
    begin = np.arange(n_lanes) * lane
    state, places, states = np.zeros(n_lanes, dtype=np.int64), [], []
    has_term = np.diff(made.first) > 0
    for step in range(lane + longest - 1):
        state = made.next(state, padded[begin + step])
        held = np.where(has_term[state], state, made.shorter[state])
        lanes = np.flatnonzero(held)
        while len(lanes):
            ending = held[lanes]
            # A lane counts the terms that begin in it.
            own = step - made.depth[ending] + 1 < lane
            places.append(begin[lanes[own]] + step)
            states.append(ending[own])
            held[lanes] = made.shorter[ending]
            lanes = lanes[held[lanes] != 0]
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(states)


def _longest(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of ``(note, start, end, term)`` the leftmost, of these the longest, then on behind its end; all terms of a span stay."""
    kept: list[tuple[int, int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], s[1], -s[2], s[3])):
        last = kept[-1] if kept else (-1, 0, 0, 0)
        if span[0] != last[0] or span[1] >= last[2] or span[1:3] == last[1:3]:
            kept.append(span)
    return kept


def tag(
    notes: DataFrame,
    lexicon: DataFrame | Automaton,
    *,
    overlaps: str = ALL,
    cues: Sequence[str] = tagger.NEGATION_CUES,
    cue_window: int = tagger.CUE_WINDOW,
    cue_stops: str | None = tagger.CUE_STOPS,
    snippet_radius: int = tagger.SNIPPET_RADIUS,
) -> DataFrame:
    """What ``tagger.tag`` finds, by an automaton; a lexicon that is not compiled yet is compiled first.

    With ``overlaps`` set to ``leftmost_longest`` a note is read from the left: the term that begins first is
    taken, of several the longest (all that have the same span), and reading goes on behind it. A null text has no mentions.
    """
    if overlaps not in (ALL, LONGEST):
        raise ValueError(f"overlaps is {ALL!r} or {LONGEST!r}")
    made = lexicon if isinstance(lexicon, Automaton) else compile_lexicon(lexicon)
    back = 2 * cue_window + 2
    id_type = dict(notes.dtypes)["note_id"]

    def found(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, loose = batch.column(2), batch.column(3)
        counts = pc.list_value_length(raw).to_numpy().astype(np.int64)
        pieces = raw.flatten()
        note = np.repeat(np.arange(batch.num_rows), counts)
        # One unknown word stands between notes.
        words = np.full(len(pieces) + batch.num_rows, -1, dtype=np.int64)
        place = np.arange(len(pieces)) + note
        words[place] = pc.fill_null(pc.index_in(loose.flatten(), value_set=made.words), -1).to_numpy()
        ends, states = _ends(made, words)
        if not len(ends):
            return None
        # From places among the words back to pieces and characters.
        owner = np.searchsorted(np.cumsum(counts + 1), ends, side="right")
        last = ends - owner
        begin = last - made.depth[states] + 1
        lengths = pc.utf8_length(pieces).to_numpy().astype(np.int64)
        reach = np.append(0, np.cumsum(lengths))
        opening = np.append(0, np.cumsum(counts))[owner]
        n_terms = made.first[states + 1] - made.first[states]
        texts: dict[int, str] = {}
        spans, context = [], {}
        for k in range(len(ends)):
            row, base = int(owner[k]), int(reach[opening[k]])
            if row not in texts:
                texts[row] = batch.column(1)[row].as_py()
            text, a, b = texts[row], int(reach[begin[k]]) - base, int(reach[last[k] + 1]) - base
            for term in range(int(made.first[states[k]]), int(made.first[states[k]] + n_terms[k])):
                lead, tail = made.leads[term], made.tails[term]
                start, end = a - len(lead), b + len(tail)
                # The text around the words must be the term's own symbols.
                if start >= 0 and text[start:a] == lead and text[b:end] == tail:
                    spans.append((row, start, end, term))
                    context[row, a] = int(reach[max(opening[k], begin[k] - back)]) - base
        if overlaps == LONGEST:
            spans = _longest(spans)
        rows = [s[0] for s in spans]
        terms = [s[3] for s in spans]
        cut = [(texts[r], start, end, context[r, start + len(made.leads[t])]) for r, start, end, t in spans]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(made.concepts[terms], pa.int64()),
             made.terms.take(pa.array(terms, pa.int64())), pa.array([s[1] for s in spans], pa.int32()),
             pa.array([t[a:b] for t, a, b, _ in cut], pa.string()), pa.array([t[min(c, a):a] for t, a, _, c in cut], pa.string()),
             pa.array([t[max(0, a - snippet_radius):b + snippet_radius] for t, a, b, _ in cut], pa.string())],
            names=["note_id", "concept_id", "term", "start", "lexical_variant", "prefix", "snippet"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.list_value_length(batch.column(2)).to_numpy()
            ends = np.cumsum(held)
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
                part = found(batch.slice(first, last - first))
                if part is not None:
                    yield part
                first = last

    pieces = F.regexp_extract_all("note_text", F.lit(_PIECE), F.lit(0))
    read = notes.filter(F.col("note_text").isNotNull()).select("note_id", "note_text", pieces.alias("pieces"))
    read = read.withColumn("loose", F.transform("pieces", tagger._loose))
    placed = map_arrow(
        read, run,
        f"note_id {id_type}, concept_id long, term string, start int, lexical_variant string, prefix string, snippet string",
    )
    return placed.select(
        "note_id", F.col("concept_id").cast("int").alias("concept_id"), "term", "start", "lexical_variant",
        tagger._certainty(F.col("prefix"), cues, cue_window, cue_stops).alias("certainty"), "snippet",
    )
