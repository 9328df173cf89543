"""Source divergence audit with in-mapper stripes (operator 13).

Every task folds its documents into stripes: a term of a language with its document frequency and
its count in each source. When the stripes of a task grow past a bound they are spilled into the
shuffle, which sorts them by key; stripes that follow each other with the same key are
merged as they stream by. Merged stripes lie in packed blocks of terms, and a block emits its
share of the divergences directly: between the sources of the language, and of each
source from the whole language.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from clinote.llm.workers import map_batches
from clinote.session import store

MIN_DOCUMENTS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Stripe entries that a task holds before it spills, and source counts of a packed block.
HELD_ENTRIES, BLOCK_COUNTS = 400_000, 100_000
#: Runs of letters A-Z and of characters beyond ASCII, on UTF-8 bytes in lower case (which changes A-Z alone).
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Stands for no term: its stripe names all sources of a language, also those without terms.
_NO_TERM = b""
_STRIPE = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_BLOCK = "lang string, terms array<binary>, sizes array<int>, sources array<string>, counts array<long>"


def _stripes(documents: DataFrame, text: str, lang: str, source: str, held_entries: int) -> DataFrame:
    """Stripes of all tasks, those of one key not yet merged."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency: dict[str, Counter] = defaultdict(Counter)
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        entries = 0
        for batch in batches:
            for words, language, origin in zip(*(c.to_pylist() for c in batch.columns)):
                found = _TERM.findall(words.lower())
                held = counts[language, origin]
                before = len(held)
                held.update(found)
                frequency[language].update(set(found))
                entries += len(held) - before
                if entries > held_entries:
                    yield from _spill(frequency, counts)
                    frequency.clear()
                    counts.clear()
                    entries = 0
        yield from _spill(frequency, counts)

    columns = documents.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
    )
    return map_batches(columns, fold, _STRIPE)


def _spill(frequency: dict[str, Counter], counts: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    for language, documents in frequency.items():
        origins = [(origin, held) for (lang, origin), held in counts.items() if lang == language]
        terms = list(documents)
        place = dict(zip(terms, range(len(terms))))
        at = [np.fromiter(map(place.__getitem__, held), np.int64, len(held)) for _, held in origins]
        n = [np.fromiter(held.values(), np.int64, len(held)) for _, held in origins]
        names = np.repeat(np.arange(len(origins)), [len(a) for a in at])
        order = np.argsort(np.concatenate(at), kind="stable")
        sources = pa.DictionaryArray.from_arrays(
            pa.array(names[order], pa.int32()), pa.array([origin for origin, _ in origins], pa.string())
        ).cast(pa.string())
        numbers = pa.array(np.concatenate(n)[order], pa.int64())
        bounds = np.append(0, np.cumsum(np.bincount(np.concatenate(at), minlength=len(terms))))
        yield _stripe_batch(
            language, [_NO_TERM], [0], np.array([0, len(origins)]), sources=pa.array([o for o, _ in origins], pa.string()),
            numbers=pa.array([0] * len(origins), pa.int64()),
        )
        docs = list(documents.values())
        for first in range(0, len(terms), 20_000):
            last = min(first + 20_000, len(terms))
            inside = slice(int(bounds[first]), int(bounds[last]))
            yield _stripe_batch(
                language, terms[first:last], docs[first:last], bounds[first:last + 1] - bounds[first],
                sources=sources[inside], numbers=numbers[inside],
            )


def _stripe_batch(
    language: str, terms: list[bytes], docs: list[int], bounds: np.ndarray, *, sources: pa.Array, numbers: pa.Array
) -> pa.RecordBatch:
    offsets = pa.array(bounds, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([language] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64()),
         pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, numbers)],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def _opens(rows: pa.Table) -> np.ndarray:
    """True where a row's key differs from that of the row before."""
    new = np.ones(rows.num_rows, dtype=bool)
    for name in ("lang", "term"):
        column = rows.column(name).combine_chunks()
        other = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = other if name == "lang" else new[1:] | other
    return new


def _merged(rows: pa.Table, new: np.ndarray, min_documents: int) -> Iterator[tuple[str, list[bytes], np.ndarray, pa.Array, np.ndarray]]:
    """Whole runs of equal keys as one stripe each, where kept: language, terms, their numbers of sources, sources, counts.

    A stripe without a term comes by itself.
    """
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    no_term = pc.equal(rows.column("term"), _NO_TERM).to_numpy()[starts]
    kept = no_term | (docs >= min_documents)
    rows, run = rows.filter(pa.array(kept[run])).combine_chunks(), run[kept[run]]
    if not rows.num_rows:
        return
    chosen, run = np.unique(run, return_inverse=True)
    lists = rows.column("sources").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    names, width = coded.dictionary, len(coded.dictionary)
    key = np.repeat(run, pc.list_value_length(lists).to_numpy()) * width + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    counts = np.add.reduceat(rows.column("counts").combine_chunks().flatten().to_numpy()[order], first)
    owner, source = np.divmod(key[order][first], width)
    sizes = np.bincount(owner, minlength=len(chosen))
    opening = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    terms = rows.column("term").take(pa.array(opening)).to_pylist()
    langs = rows.column("lang").take(pa.array(opening)).to_pylist()
    bounds = np.append(0, np.cumsum(sizes))
    single = no_term[chosen]
    at = 0
    while at < len(terms):
        end = at + 1
        while not single[at] and end < len(terms) and langs[end] == langs[at] and not single[end]:
            end += 1
        inside = slice(bounds[at], bounds[end])
        yield langs[at], terms[at:end], sizes[at:end], names.take(pa.array(source[inside])), counts[inside]
        at = end


def _merge(min_documents: int):
    """Merge sorted stripes of equal keys and pack the kept ones; what names the sources is a block of its own."""
    def packed(language: str, parts: list[tuple]) -> pa.RecordBatch:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([language], pa.string()), one(pa.array([t for p in parts for t in p[0]], pa.binary())),
             one(pa.array(np.concatenate([p[1] for p in parts]), pa.int32())), one(pa.concat_arrays([p[2] for p in parts])),
             one(pa.array(np.concatenate([p[3] for p in parts]), pa.int64()))],
            names=["lang", "terms", "sizes", "sources", "counts"],
        )

    def pack(stripes: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        parts, of, held = [], None, 0
        for language, *part in stripes:
            alone = part[0][0] == _NO_TERM
            if parts and (alone or language != of or held > BLOCK_COUNTS):
                yield packed(of, parts)
                parts, held = [], 0
            if alone:
                yield packed(language, [part])
            else:
                parts, of, held = [*parts, part], language, held + len(part[3])
        if parts:
            yield packed(of, parts)

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            new = _opens(rows)
            # The last key may go on in the next batch.
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from _merged(rows.slice(0, last), new[:last], min_documents)
            rest = rows.slice(last)
        if rest is not None:
            yield from _merged(rest, _opens(rest), min_documents)

    return lambda batches: pack(stripes(batches))


def _frames(blocks: DataFrame) -> DataFrame:
    """``lang, n_terms, names, totals``: the kept terms of a language, its sources and their counts of kept terms."""
    n_terms = blocks.groupBy("lang").agg(
        F.sum(F.when(F.element_at("terms", 1) != _NO_TERM, F.size("terms")).otherwise(0)).alias("n_terms")
    )
    totals = blocks.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", "sources").agg(
        F.sum("counts").alias("total")
    )
    # One entry per source of a language.
    gathered = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("sources", "total"))).alias("all"))
    return gathered.join(n_terms, "lang").select(
        "lang", "n_terms", F.col("all.sources").alias("names"), F.col("all.total").alias("totals")
    )


def _share(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / below)`` in integers that hold it."""
    if counts.size and int(counts.max()) >= 9_000_000_000:
        counts = counts.astype(object)
    return 1 + (SCALE * (counts + 1) // np.maximum(below, 1)).astype(np.int64)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _emit(top_terms: int):
    """What a task's blocks add to each pair of sources, and its best terms of each source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        names_of: dict[str, list[str]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                language, names = row["lang"], row["names"]
                place = {s: k for k, s in enumerate(names)}
                if language not in pairs:
                    names_of[language], pairs[language] = names, np.zeros((len(names), len(names)), dtype=np.int64)
                if row["terms"][0] == _NO_TERM:
                    continue
                totals = np.array(row["totals"], dtype=np.int64)
                columns = np.fromiter(map(place.__getitem__, row["sources"]), np.int64, len(row["sources"]))
                counts = np.array(row["counts"], dtype=np.int64)
                ends = np.cumsum(row["sizes"])
                step = max(1, 1_000_000 // len(names))
                for first in range(0, len(ends), step):
                    terms, sizes = row["terms"][first:first + step], row["sizes"][first:first + step]
                    inside = slice(ends[first] - sizes[0], ends[first + len(sizes) - 1])
                    dense = np.zeros((len(sizes), len(names)), dtype=np.int64)
                    dense[np.repeat(np.arange(len(sizes)), sizes), columns[inside]] = counts[inside]
                    p = _share(dense, totals[None, :] + row["n_terms"])
                    for k in range(len(names)):
                        pairs[language][k] += _divergence(p[:, k:k + 1], p).sum(0)
                    whole = _share(dense.sum(1), totals.sum() + row["n_terms"])[:, None]
                    value = np.where((dense > 0) & (p > whole), _divergence(p, whole), -1)
                    for k, origin in enumerate(names):
                        rows = np.flatnonzero(value[:, k] >= 0)
                        if len(rows) > top_terms:
                            least = -np.partition(-value[rows, k], top_terms - 1)[top_terms - 1]
                            rows = rows[value[rows, k] >= least]
                        # Larger values first, then smaller terms.
                        found = [(-int(value[r, k]), terms[r]) for r in rows]
                        held = best[language, origin]
                        best[language, origin] = heapq.nsmallest(top_terms, held + found)
        made = [
            (language, a, "pair", b.encode(), int(added[i, j]))
            for language, added in pairs.items()
            for i, a in enumerate(names_of[language]) for j, b in enumerate(names_of[language]) if i != j
        ] + [
            (language, origin, "term", term, -value)
            for (language, origin), found in best.items() for value, term in found
        ]
        for at in range(0, len(made), 20_000):
            columns = zip(*made[at:at + 20_000])
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"]
            )

    return run


def term_stripes(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    min_documents: int = MIN_DOCUMENTS, held_entries: int = HELD_ENTRIES,
) -> DataFrame:
    """Stored blocks of merged stripes of the terms that are in at least ``min_documents`` documents of a language.

    ``lang, terms, sizes, sources, counts``: ``sizes`` counts the sources of each term, whose names and
    counts follow each other. One block of a language has the empty term and names all its sources.
    """
    folded = _stripes(documents, text, lang, source, held_entries)
    dealt = folded.repartition(F.col("lang"), F.col("term")).sortWithinPartitions("lang", "term")
    return store(documents.sparkSession, map_batches(dealt, _merge(min_documents), _BLOCK), "term-stripes")


def audit(
    documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, held_entries: int = HELD_ENTRIES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart, and by what.

    Null text, language and source are empty. A term is a run of ASCII letters and of characters
    beyond ASCII, A-Z in lower case. Within a language, with V kept terms, a source whose kept terms occur N times
    gives each of them the share ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, and the language itself
    likewise. ``pair``: for each other source the sum of ``floor((p - q)^2 / q)`` over the kept terms, 0 where there are none.
    ``term``: the ``top_terms`` terms of the source whose share is above the language's, by the same value. Ranks
    go by value, then by item in UTF-8. Equal rows count as often as they occur; an empty table gives no rows.

    A task holds the stripes up to ``held_entries`` and one document's terms; the number of sources of a
    language squared must fit into a task, as it is the number of pairs returned.
    """
    blocks = term_stripes(
        documents, text=text, lang=lang, source=source, min_documents=min_documents, held_entries=held_entries
    )
    # Stored, so that the planner knows that they are small.
    frames = store(documents.sparkSession, _frames(blocks), "language-frames")
    emitted = map_batches(
        blocks.join(frames, "lang").select("lang", "terms", "sizes", "sources", "counts", "n_terms", "names", "totals"),
        _emit(top_terms), "lang string, source string, part string, item binary, value long",
    )
    # A term is in one block; what the blocks add to a pair is summed.
    summed = emitted.groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top_terms)).select(
        "lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank"
    )


def sql(min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> str:
    """The rows of ``audit`` over ``documents`` as SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = f"1 + {SCALE}::hugeint * (coalesce({{count}}, 0) + 1) // ({{total}} + v)"
    return rf"""
    with doc as (
        select row_number() over () as d, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source
        from documents
    ),
    word as (
        select d, lang, source, unnest(regexp_extract_all(
            translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from doc
    ),
    kept as materialized (select lang, term from word group by lang, term having count(distinct d) >= {min_documents}),
    counted as materialized (
        select lang, source, term, count(*) as n from word semi join kept using (lang, term) group by all
    ),
    vocabulary as (select lang, count(*) as v from kept group by lang),
    grp as (
        select lang, source, coalesce(v, 0) as v, coalesce(total, 0) as total
        from (select distinct lang, source from doc) left join vocabulary using (lang)
        left join (select lang, source, sum(n) as total from counted group by all) using (lang, source)
    ),
    whole as materialized (
        select lang, term, {share.format(count="sum(n)", total="any_value(total)")} as q
        from counted join (select lang, any_value(v) as v, sum(total) as total from grp group by lang) using (lang)
        group by lang, term, v
    ),
    p as materialized (
        select g.lang, g.source, k.term, n, {share.format(count="n", total="total")} as p
        from grp g join kept k on k.lang = g.lang
        left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term
    ),
    value as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
        from grp a join grp b on a.lang = b.lang and a.source <> b.source
        left join p x on x.lang = a.lang and x.source = a.source
        left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
        group by all
        union all
        select lang, source, 'term', term, (p - q) * (p - q) // q
        from p join whole using (lang, term) where n > 0 and p > q
    ),
    ranked as (
        select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from value
    )
    select lang, source, part, item, cast(value as bigint) as value, rank from ranked
    where part = 'pair' or rank <= {top_terms}"""
