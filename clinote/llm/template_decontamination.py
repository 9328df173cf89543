"""Benchmark decontamination by template canonicalisation (operator 6).

Numbers, names (capitalised words) and units behind numbers become typed placeholders, so
a question with other numbers and names keeps its template. Windows of template words are
hash-joined with those of the benchmark, windows of mostly placeholders by their values. The matches of a document and an item that lie
on one alignment must fill the placeholders consistently: what stands for one value of the
item is one value in the document. Alignments close to each other count together, as words
may be inserted or removed. Chance matches of templates fail this; verbatim copies,
re-parameterised questions and edited ones pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clinote.llm.words import NOT_WORD, mix, spans_hashed, weights, words_between_blanks
from clinote.llm.workers import map_batches, slices

WINDOW = 8
#: Fewer words in a window, or literal words in a short item with collapsed runs, would be met by chance.
MIN_WINDOW, MIN_LITERAL = 4, 3
MIN_COVERAGE = 0.5
#: Hashes of benchmark windows that tasks may hold (32 MB); beyond that, all windows are joined.
MAX_HELD_HASHES = 4_000_000
UNITS = (
    "mm cm dm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t lb lbs oz pound pounds ton tons "
    "ml cl dl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years eur usd gbp euro euros dollar dollars cent cents percent degrees degree "
    "kb mb gb tb w kw mw v a hz khz mhz ghz j kj cal kcal n pa kpa bar mol"
).split()
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
_SLICE_BYTES = 2 << 20
_EXACT = np.uint64(0x5851F42D4C957F2D)
_KINDS = mix(np.array([11, 12, 13], dtype=np.uint64))  # number, name, unit


def _unit_hashes() -> np.ndarray:
    data, starts, lengths, _ = words_between_blanks(pa.array([" ".join(UNITS)]))
    return np.sort(spans_hashed(data, starts, lengths))


_UNIT_HASHES = _unit_hashes()


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _apart(texts: pa.Array) -> pa.Array:
    """The texts with blanks around characters of scripts that are written without them, which are words each."""
    unspaced = pc.match_substring_regex(texts, _UNSPACED)
    if not pc.any(unspaced).as_py():
        return texts
    return pc.if_else(unspaced, pc.replace_substring_regex(texts, f"({_UNSPACED})", r" \1 "), texts)


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template word, value and placeholder flag of every word, and the number of words per text."""
    plain = pc.replace_substring_regex(pc.fill_null(texts, ""), r"(\d)[.,](\d)", r"\1\2")
    plain = _apart(pc.binary_join_element_wise(" ", pc.replace_substring_regex(plain, NOT_WORD, " "), ""))
    marked = pc.replace_substring_regex(plain, r" (\p{Lu}[\p{Ll}\p{M}]+)", r" ^\1")
    data, starts, _, counts = words_between_blanks(marked)
    first = data[starts]
    data, starts, lengths, _ = words_between_blanks(pc.utf8_lower(plain))
    value = spans_hashed(data, starts, lengths)
    is_number, is_name = (first >= 48) & (first <= 57), first == ord("^")
    is_unit = np.append(False, is_number[:-1])[:len(value)] & _member(value, _UNIT_HASHES)
    template = np.select([is_number, is_name, is_unit], list(_KINDS), value)
    return template, value, is_number | is_name | is_unit, counts


def collapsed(
    template: np.ndarray, value: np.ndarray, is_slot: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with every run of numbers, and every run of names, as one placeholder; the words of each."""
    if not len(template):
        return template, value, is_slot, counts, np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    repeats = (template[1:] == template[:-1]) & (owner[1:] == owner[:-1]) & np.isin(template[1:], _KINDS[:2])
    first = np.flatnonzero(np.append(True, ~(repeats & is_slot[1:])))
    lengths = np.diff(np.append(first, len(template)))
    inside = np.arange(len(template)) - np.repeat(first, lengths)
    joined = np.add.reduceat(value * weights(int(lengths.max()))[inside], first)
    joined = np.where(lengths > 1, mix(joined, 1), value[first])
    return template[first], joined, is_slot[first], np.bincount(owner[first], minlength=len(counts)), lengths


def window_size(n_words: int, window: int) -> int:
    """Words in a window of an item: a third of it at most, so that a changed word leaves half of the windows."""
    return n_words if n_words < window else min(window, max(MIN_WINDOW, (n_words + 1) // 3))


def windows(
    template: np.ndarray, value: np.ndarray, is_slot: np.ndarray, counts: np.ndarray, sizes: list[int], form: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: hash, first word and text of the windows, and whether over half the words are placeholders.

    The hash of those is that of their values, so that only equal words meet them.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    slots = np.concatenate([[0], np.cumsum(is_slot)])
    hashes, exact = np.zeros(len(template), dtype=np.uint64), np.zeros(len(template), dtype=np.uint64)
    weight = weights(max(sizes, default=1))
    for size in range(1, min(max(sizes, default=0), len(template)) + 1):
        n = len(template) - size + 1
        hashes = hashes[:n] + template[size - 1:] * weight[size - 1]
        exact = exact[:n] + value[size - 1:] * weight[size - 1]
        if size in sizes:
            first = np.flatnonzero(owner[:n] == owner[size - 1:])
            slotted = 2 * (slots[first + size] - slots[first]) > size
            chosen = np.where(slotted, exact[first] + _EXACT, hashes[first])
            yield size, mix(chosen, 2 * size + form), first, owner[first], slotted


class _Held:
    """Sorted hashes with a table of bits that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << min(24, max(16, (8 * len(hashes)).bit_length()))) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[hashes & self.mask] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[hashes & self.mask])
        return maybe[_member(hashes[maybe], self.hashes)]


def _emit(
    keys: pa.Array, texts: pa.Array, sizes: list[list[int]], held: _Held | None, window: int | None
) -> pa.RecordBatch:
    words, parts = canonical(texts), []
    as_words = (*words, np.ones(len(words[0]), np.int64))
    for form, (template, value, is_slot, counts, lengths) in enumerate((as_words, collapsed(*words))):
        starts = np.cumsum(counts) - counts
        literal = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[is_slot], minlength=len(counts))
        whole = (counts == words[3]) | (literal >= MIN_LITERAL)
        for size, hashes, first, owner, slotted in windows(template, value, is_slot, counts, sizes[form], form):
            if held is not None:
                hit = held.places(hashes)
            elif window is not None:  # of items
                wanted = np.array([window_size(n, window) == size for n in counts.tolist()], dtype=bool)
                hit = np.flatnonzero((wanted & ((counts >= window) | whole))[owner])
            else:
                hit = np.arange(len(first))
            hashes, first, owner, slotted = hashes[hit], first[hit], owner[hit], slotted[hit]
            filled = [value[a:a + size][is_slot[a:a + size]].view(np.int64) for a in first]
            n, at = len(first), first - starts[owner]
            last = first + size - 1
            ends = [is_slot[first] & (at == 0), is_slot[last] & (at + size == counts[owner])]
            runs = [lengths[first] > 1, lengths[last] > 1]
            parts.append((hashes, owner, at, np.full(n, form), np.full(n, size), *ends, *runs, slotted, filled))
    if not parts:
        parts = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4, *[np.empty(0, bool)] * 5, [])]
    hashes, owner, at, form, size, *flags = (np.concatenate(p) for p in list(zip(*parts))[:-1])
    filled = [f for p in parts for f in p[-1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.view(np.int64)), keys.take(pa.array(owner, pa.int64())), pa.array(at, pa.int64()),
         pa.array(form, pa.int32()), pa.array(size, pa.int32()), *(pa.array(f, pa.bool_()) for f in flags),
         pa.array(filled, pa.list_(pa.int64()))],
        names=["hash", "key", "at", "form", "size", "slot_first", "slot_last", "run_first", "run_last", "slotted",
               "filled"],
    )


def _windows_of(df: DataFrame, sizes: list[list[int]], held: np.ndarray | None, window: int | None = None) -> DataFrame:
    """The windows of ``df`` (``key, text``) in both forms: words (0) and collapsed runs (1).

    Of the held hashes if given; of the size for its length if ``window`` is given. Placeholders
    that begin or end a text, and runs that begin or end a window, are marked.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if held is None else _Held(held)
        for batch in slices(batches, "text", _SLICE_BYTES):
            yield _emit(batch.column(0), batch.column(1), sizes, known, window)

    return map_batches(
        df, run, f"hash long, key {dict(df.dtypes)['key']}, at long, form int, size int, slot_first boolean, "
        "slot_last boolean, run_first boolean, run_last boolean, slotted boolean, filled array<long>",
    )


def _consistent(hits: Column) -> Column:
    """The hits of one alignment without those that hold a value which stands for several values."""
    slots = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["slots"])))
    several = F.filter(
        F.array_distinct(F.transform(slots, lambda s: s["wanted"])),
        lambda v: F.size(F.filter(slots, lambda s: s["wanted"] == v)) > 1,
    )
    return F.filter(hits, lambda h: ~F.exists(h["slots"], lambda s: F.array_contains(several, s["wanted"])))


def _with_covered(found: Column, slotted: Column, size: Column) -> Column:
    """The windows found on one alignment, and those of mostly placeholders whose words all lie in such windows."""
    words = F.flatten(F.transform(found, lambda a: F.sequence(a, a + size - 1)))
    covered = F.filter(slotted, lambda a: F.size(F.array_except(F.sequence(a, a + size - 1), words)) == 0)
    return F.when(F.size(slotted) > 0, F.array_union(found, covered)).otherwise(found)


def find(
    documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, min_coverage: float = MIN_COVERAGE,
    max_held_hashes: int = MAX_HELD_HASHES,
) -> DataFrame:
    """``key, item, coverage, same_values``: documents that hold an item or a re-parameterised form of it.

    ``coverage`` is the share of the item's windows found in one neighbourhood of about the
    item's length, at least ``min_coverage``; inserted, removed or changed words only take the
    windows that they touch. On each alignment the windows whose placeholders contradict each
    other do not count. It is the larger of two shares: over words, and with each run of names
    or numbers as one placeholder, so that names may have more or fewer words. ``same_values``
    tells that the placeholders hold the item's values. An item of fewer than ``window`` words
    is one window. Windows that are mostly placeholders are found with the item's own values, or
    where windows found on the same alignment cover their words. Characters of scripts without blanks are words each.
    An item without any word is found by its symbols in a row, blanks aside; one without symbols either is nothing.
    Rows without key, item or text give nothing; repeated rows count
    once; further columns are left out.
    """
    items = benchmark.select(F.col(item).alias("key"), F.col(item_text).alias("text"))
    items = items.filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    counted = _windows_of(items, [list(range(1, window + 1))] * 2, None, window).withColumnRenamed("key", "item")
    counted = counted.drop("run_first", "run_last").dropDuplicates(["hash", "item", "at"])
    found_sizes = counted.select("form", "size").distinct().collect()  # at most two times ``window`` rows
    sizes = [sorted(r["size"] for r in found_sizes if r["form"] == form) for form in (0, 1)]
    distinct = counted.select("hash").distinct()
    sample = distinct.limit(max_held_hashes + 1)
    n = sample.count()
    held = None
    if n <= max_held_hashes:
        held = np.sort(np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("text").isNotNull())
    of_documents = _windows_of(rows, sizes, held).select(
        "hash", "key", F.col("at").alias("doc_at"), F.col("filled").alias("doc_filled"), "run_first", "run_last"
    )
    totals = counted.groupBy("item", "form").agg(
        F.count_distinct("at").alias("total"), (F.max("at") + F.max("size")).alias("reach"),
        F.max("size").alias("size"), F.collect_set(F.when(F.col("slotted"), F.col("at"))).alias("slotted"),
    )
    matched = of_documents.join(counted, "hash")
    # At the ends of an item a run of the document may be longer than what stands for the item's, and says nothing.
    slots = F.arrays_zip(F.col("filled").alias("wanted"), F.col("doc_filled").alias("found"))
    skipped = F.when(F.col("slot_first") & F.col("run_first"), 1).otherwise(0)
    left = F.size("filled") - skipped - F.when(F.col("slot_last") & F.col("run_last"), 1).otherwise(0)
    hit = F.struct("at", F.slice(slots, skipped + 1, F.greatest(left, F.lit(0))).alias("slots"))
    aligned = matched.groupBy("key", "item", "form", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        _consistent(F.collect_set(hit)).alias("hits")
    ).filter(F.size("hits") > 0)
    same = F.forall("hits", lambda h: F.forall(h["slots"], lambda s: s["wanted"] == s["found"]))
    aligned = aligned.join(totals, ["item", "form"])
    found = F.transform("hits", lambda h: h["at"])
    aligned = aligned.select(
        "key", "item", "form", "total", same.alias("same"), _with_covered(found, F.col("slotted"), F.col("size")).alias("windows"),
        # Two overlapping stretches of shifts: shifts not further apart than the item reaches share one.
        F.explode(F.array(*[F.floor(F.col("shift") / F.col("reach")) + k for k in (0, 1)])).alias("stretch"),
    )
    near = aligned.groupBy("key", "item", "form", "stretch").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("windows")))) / F.first("total")).alias("coverage"),
        F.bool_and("same").alias("same_values"),
    )
    best = near.filter(F.col("coverage") >= min_coverage).groupBy("key", "item").agg(
        F.max(F.struct("coverage", "same_values")).alias("best")
    )
    found = best.select(F.col("key").alias(key), F.col("item").alias(item), "best.coverage", "best.same_values")
    wordless = _wordless(items)
    lengths = [r[0] for r in wordless.select(F.length("symbols")).distinct().collect()]
    if not lengths:
        return found
    met = _symbol_runs(rows, lengths).join(wordless, "symbols").select(F.col("key").alias(key), F.col("item").alias(item))
    return found.unionByName(met.distinct().withColumns({"coverage": F.lit(1.0), "same_values": F.lit(True)}))


_WORDS, _BLANKS = r"[\p{L}\p{M}\p{N}]+", r"(?U)\s+"


def _wordless(items: DataFrame) -> DataFrame:
    """``item, symbols`` of the items without a letter or digit."""
    symbols = F.regexp_replace("text", _BLANKS, "")
    return items.filter(~F.col("text").rlike(_WORDS)).select(F.col("key").alias("item"), symbols.alias("symbols")).filter(
        "symbols <> ''"
    )


def _symbol_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``key, symbols``: all stretches of these lengths of the symbols that stand between two words."""
    between = F.explode(F.split(F.regexp_replace("text", _BLANKS, ""), _WORDS))
    runs = rows.select("key", between.alias("run")).filter(F.length("run") >= min(lengths))

    def stretches(n: int) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda at: F.substring("run", at, F.lit(n)))
        return F.when(F.length("run") >= n, all_of).otherwise(F.array().cast("array<string>"))

    cut = [stretches(n) for n in lengths]
    return runs.select("key", F.explode(F.concat(*cut)).alias("symbols"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents``, with all columns, in which no item is found; rows without a key are kept."""
    found = find(documents, benchmark, key=key, **options).select(F.col(key).alias("__found")).distinct()
    return documents.join(found, documents[key] == found["__found"], "left_anti")
