"""Vector code compression by product quantisation in whole numbers (operator 12).

Vectors become integers and are cut into parts; every part position has a codebook, trained in
rounds of exact integer arithmetic. The vectors are laid down once, in *runs* of a few thousand:
in a run each part is sorted along a Hilbert curve and cut into flat blocks that know their
smallest box, their sum and their size. A round compares boxes with entries first: an entry
whose least distance from a box is more than another's largest one cannot be nearest to
anything inside, so a block has a shortlist. A block with one entry on it adds its stored sum;
the others are evaluated by a kernel of the narrowest integers that hold all distances.

A run holds all parts of its vectors, so no vector is shuffled: a round moves one sum per task
and entry, and the codes of a vector are put together where they are found.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clinote.llm.workers import map_batches
from clinote.session import store

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
RUN_ROWS, RUN_VALUES, BLOCK_ROWS = 8192, 1 << 20, 64
_CURVE_AXES, _CURVE_BITS = 12, 60
_LONG_MAX = (1 << 63) - 1
_RUN_SCHEMA = "width int, places binary, numbers binary"


def _finite(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _bounds(length: int, parts: int) -> list[int]:
    """Where the parts begin and end; equal where the length allows it."""
    return [k * length // parts for k in range(parts + 1)]


def scaled(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` exactly: 64-bit integers where all distances fit, else Python's integers."""
    product = np.floor(vectors * scale)
    if np.abs(product).max(initial=0) < 1 << 26:
        return product.astype(np.int64)
    whole = [[math.floor(Fraction(float(x)) * scale) for x in row] for row in vectors]
    return np.array(whole, dtype=object).reshape(vectors.shape)


def _narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the narrowest integers in which sums of squared differences of them are exact."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    most = 4 * (top + 1) ** 2 * max(1, arrays[0].shape[-1])
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    return [a.astype(kind) for a in arrays]


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """The order of integer points along a Hilbert curve through their box (its widest axes)."""
    n, axes = points.shape
    if n < 2 or not axes:
        return np.arange(n)
    low, spread = points.min(0), (points.max(0) - points.min(0)).astype(np.float64)
    chosen = np.argsort(-spread, kind="stable")[:_CURVE_AXES]
    bits = min(10, _CURVE_BITS // len(chosen))
    span = np.where(spread[chosen] > 0, spread[chosen], 1.0)
    cells = ((points[:, chosen] - low[chosen]).astype(np.float64) / span * ((1 << bits) - 1)).astype(np.int64).T.copy()
    # From axes to the transposed index of the curve: undo the turns level by level, then Gray code.
    for bit in range(bits - 1, 0, -1):
        level, below = np.int64(1 << bit), np.int64((1 << bit) - 1)
        for axis in range(len(cells)):
            turned = (cells[axis] & level) != 0
            swapped = np.where(turned, 0, (cells[0] ^ cells[axis]) & below)
            cells[0] ^= np.where(turned, below, swapped)
            cells[axis] ^= swapped
    for axis in range(1, len(cells)):
        cells[axis] ^= cells[axis - 1]
    flips = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where(cells[-1] & (1 << bit), (1 << bit) - 1, 0)
    cells ^= flips
    key = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(cells)):
            key = (key << 1) | ((cells[axis] >> bit) & 1)
    return np.argsort(key, kind="stable")


def _pack(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes per number and the numbers; 0 stands for decimal text."""
    if values.dtype == object:
        return 0, ",".join(map(str, values.ravel())).encode()
    top = int(np.abs(values).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return width, values.astype(f"<i{width}").tobytes()


def _unpack(width: int, data: bytes) -> np.ndarray:
    if width == 0:
        return np.array([int(x) for x in data.split(b",")] if data else [], dtype=object)
    return np.frombuffer(data, f"<i{width}").astype(np.int64)


class _Part:
    """One part position of a run: vectors in curve order, flat blocks with box, sum and size."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        firsts = np.arange(0, len(numbers), BLOCK_ROWS)
        self.sizes = np.diff(np.append(firsts, len(numbers)))
        if numbers.shape[1]:
            self.low, self.high = np.minimum.reduceat(numbers, firsts), np.maximum.reduceat(numbers, firsts)
            self.sums = np.add.reduceat(numbers, firsts)
        else:
            self.low = self.high = self.sums = np.zeros((len(firsts), 0), dtype=np.int64)

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """True per block and entry where the entry may be nearest to a vector of the block."""
        low, high, entries = _narrow(self.low, self.high, book)
        under, over = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
        least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(2)
        return least <= most.min(1)[:, None]

    def nearest(self, book: np.ndarray, listed: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of the vectors of the wanted blocks; ties go to the lower index."""
        numbers, entries = _narrow(self.numbers, book)
        entry, best = np.full(len(numbers), -1), np.zeros(len(numbers), dtype=numbers.dtype)
        for e in range(len(entries)):
            rows = np.flatnonzero(np.repeat(listed[:, e] & wanted, self.sizes))
            distance = ((numbers[rows] - entries[e]) ** 2).sum(1).astype(numbers.dtype)
            closer = (entry[rows] < 0) | (distance < best[rows])
            entry[rows[closer]], best[rows[closer]] = e, distance[closer]
        return entry, best

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the vectors nearest to each entry."""
        count = np.zeros(len(book), dtype=np.int64)
        total = np.zeros(book.shape, dtype=self.numbers.dtype)
        listed = self.shortlists(book)
        settled = listed.sum(1) == 1
        whole = np.argmax(listed[settled], axis=1)
        np.add.at(count, whole, self.sizes[settled])
        np.add.at(total, whole, self.sums[settled])
        if not settled.all():
            entry, _ = self.nearest(book, listed, ~settled)
            rows = np.flatnonzero(entry >= 0)
            np.add.at(count, entry[rows], 1)
            np.add.at(total, entry[rows], self.numbers[rows])
        return count, total


def _run_parts(width: int, data: bytes, rows: int, bounds: list[int]) -> Iterator[_Part]:
    numbers, at = _unpack(width, data), 0
    for first, last in zip(bounds, bounds[1:]):
        yield _Part(numbers[at:at + rows * (last - first)].reshape(rows, last - first))
        at += rows * (last - first)


@dataclasses.dataclass(frozen=True)
class Codes:
    """Trained codebooks and the stored runs they were trained on."""

    runs: DataFrame | None
    books: list[list[list[int]]]
    bounds: list[int]

    def digest(self) -> str:
        """SHA-256 of all final components as decimal integers, by part, entry and position."""
        numbers = ",".join(str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def lay_down(df: DataFrame, length: int, *, key: str, vector: str, label: str, parts: int = PARTS,
             scale: int = SCALE) -> DataFrame:
    """The usable vectors of the given length as runs: ``keys, labels, width, places, numbers``."""
    bounds = _bounds(length, parts)
    key_type, label_type = df.schema[key].dataType.simpleString(), df.schema[label].dataType.simpleString()
    most = max(1, min(RUN_ROWS, RUN_VALUES // max(1, length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            rows = table.num_rows
            flat = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            numbers = scaled(flat.astype(np.float64).reshape(rows, length), scale)
            orders = [hilbert_order(numbers[:, a:b]) for a, b in zip(bounds, bounds[1:])]
            sorted_parts = [numbers[o, a:b].ravel() for o, a, b in zip(orders, bounds, bounds[1:])]
            width, data = _pack(np.concatenate(sorted_parts))
            places = np.concatenate(orders).astype("<i4").tobytes()
            one = lambda column: pa.ListArray.from_arrays(
                pa.array([0, rows], pa.int32()), column.combine_chunks())
            return pa.RecordBatch.from_arrays(
                [one(table.column(0)), one(table.column(1)), pa.array([width], pa.int32()),
                 pa.array([places], pa.binary()), pa.array([data], pa.binary())],
                names=["keys", "labels", "width", "places", "numbers"],
            )

        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = min(batch.num_rows - at, most - rows)
                held.append(batch.slice(at, taken))
                at, rows = at + taken, rows + taken
                if rows == most:
                    yield laid(held)
                    held, rows = [], 0
        if rows:
            yield laid(held)

    columns = df.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"), F.col(f"`{vector}`").cast("array<double>").alias("v")
    ).filter(_finite(F.col("v")) & (F.size("v") == length))
    return map_batches(columns, run, f"keys array<{key_type}>, labels array<{label_type}>, {_RUN_SCHEMA}")


def _sums(runs: DataFrame, books: list[np.ndarray], bounds: list[int]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and sum of the part vectors nearest to each entry, of all runs: a row per part and entry."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for width, places, data in zip(*(batch.column(n).to_pylist() for n in ("width", "places", "numbers"))):
                rows = len(places) // (4 * len(books))
                for p, part in enumerate(_run_parts(width, data, rows, bounds)):
                    counts, sums = part.totals(books[p])
                    for e in np.flatnonzero(counts):
                        at = (p, int(e))
                        count[at] = count.get(at, 0) + int(counts[e])
                        total[at] = [a + int(b) for a, b in zip(total.get(at, [0] * len(sums[e])), sums[e])]
        yield _sum_rows([(p, e, n, total[p, e]) for (p, e), n in count.items()])

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        total = [sum(int(x) for x in column) for column in zip(*(r["total"] for r in rows))]
        made = _sum_rows([(rows[0]["part"], rows[0]["entry"], sum(r["n"] for r in rows), total)])
        return pa.Table.from_batches([made])

    # Sums travel as decimal text, so that they are exact at any size.
    schema = "part int, entry int, n long, total array<string>"
    folded = map_batches(runs.select("width", "places", "numbers"), fold, schema)
    merged = folded.groupBy("part", "entry").applyInArrow(add, schema)
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["total"]]) for r in merged.collect()}


def _sum_rows(rows: list[tuple[int, int, int, list[int]]]) -> pa.RecordBatch:
    parts, entries, counts, totals = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(counts, pa.int64()),
         pa.array([[str(x) for x in t] for t in totals], pa.list_(pa.string()))],
        names=["part", "entry", "n", "total"],
    )


def _book_arrays(books: list[list[list[int]]], bounds: list[int]) -> list[np.ndarray]:
    made = []
    for book, first, last in zip(books, bounds, bounds[1:]):
        large = any(abs(x) >= 1 << 62 for entry in book for x in entry)
        made.append(np.array(book, dtype=object if large else np.int64).reshape(len(book), last - first))
    return made


def train(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Codebooks of all usable vectors of ``df``.

    A vector is usable if it is not null and all its components are there and finite. Where
    lengths differ, the commonest one counts (of equally common ones the longest) and vectors of other lengths
    are left out; a length that cannot be cut into equal parts is cut as evenly as it goes.
    Codebooks start from the usable vectors of the smallest keys (equal keys by their components,
    null keys last), fewer where there are fewer vectors. Components of any size are exact. An empty
    table gives no runs and empty codebooks.
    """
    column = F.col(f"`{vector}`").cast("array<double>")
    usable = df.select(F.col(f"`{key}`").alias("k"), column.alias("v")).filter(_finite(F.col("v")))
    lengths = usable.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if commonest is None:
        return Codes(None, [[] for _ in range(parts)], _bounds(0, parts))
    length = commonest["length"]
    bounds = _bounds(length, parts)
    # As many rows as a codebook has entries.
    firsts = usable.filter(F.size("v") == length).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    start = scaled(np.array([r["v"] for r in firsts], dtype=np.float64).reshape(len(firsts), length), scale)
    books = [[[int(x) for x in row[a:b]] for row in start] for a, b in zip(bounds, bounds[1:])]
    runs = store(
        df.sparkSession, lay_down(df, length, key=key, vector=vector, label=label, parts=parts, scale=scale), "vector-runs"
    )
    for _ in range(rounds):
        for (p, e), (n, total) in _sums(runs, _book_arrays(books, bounds), bounds).items():
            books[p][e] = [x // n for x in total]
    return Codes(runs, books, bounds)


def encode(codes: Codes, spark, key: str, key_type: str, label_type: str) -> DataFrame:
    """``key, label, code, error``: a row per usable vector, repeated rows included.

    ``code`` has two hex digits per part; ``error`` is the squared distance summed over the parts (at
    most the largest long).
    """
    schema = f"`{key}` {key_type}, label {label_type}, code string, error long"
    if codes.runs is None:
        return spark.createDataFrame([], schema)
    books, bounds = _book_arrays(codes.books, codes.bounds), codes.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = (batch.column(n).to_pylist() for n in ("width", "places", "numbers"))
            for row, (width, places, data) in enumerate(zip(*fields)):
                order = np.frombuffer(places, "<i4").reshape(len(books), -1)
                found = np.zeros(order.shape[::-1], dtype=np.uint8)
                error = [0] * order.shape[1]
                for p, part in enumerate(_run_parts(width, data, order.shape[1], bounds)):
                    listed = part.shortlists(books[p])
                    entry, distance = part.nearest(books[p], listed, np.ones(len(listed), dtype=bool))
                    found[order[p], p] = entry
                    back = np.empty(len(entry), dtype=distance.dtype)
                    back[order[p]] = distance
                    error = [a + int(b) for a, b in zip(error, back)]
                digits = found.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1).flatten(), batch.column(1).slice(row, 1).flatten(),
                     pa.array([digits[a:a + step] for a in range(0, len(digits), step)], pa.string()),
                     pa.array([min(e, _LONG_MAX) for e in error], pa.int64())],
                    names=[key, "label", "code", "error"],
                )

    return map_batches(codes.runs.select("keys", "labels", "width", "places", "numbers"), run, schema)


def decode(codes: Codes, code: str, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    numbers = [x for p, book in enumerate(codes.books) for x in book[int(code[2 * p:2 * p + 2], 16)]]
    return [x / scale for x in numbers]


def compress(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options
) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256``: a row per usable vector (see ``train``).

    ``label_error`` sums the errors of all vectors of a label; null labels are one label. Sums beyond a
    long are given as the largest long.
    """
    codes = train(df, key=key, vector=vector, label=label, **options)
    kinds = [df.schema[c].dataType.simpleString() for c in (key, label)]
    coded = store(df.sparkSession, encode(codes, df.sparkSession, key, *kinds), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG_MAX).cast("decimal(38,0)"))
    labels = coded.groupBy(F.col("label").alias("same")).agg(total.cast("long").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("same"))).select(
        key, "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256")
    )


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rows of ``compress`` over ``embeddings`` as SQL, for vectors of one length."""
    steps = [f"""
    kept as materialized (
        select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding
        from embeddings
        where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    ),
    flat as (select r, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) as n from kept),
    num as materialized (
        select r, i // (n // {parts}) as part, i % (n // {parts}) as pos, cast(floor({scale} * cast(x as double)) as bigint) as v
        from flat
    ),
    book0 as materialized (select part, r - 1 as entry, pos, v as c from num where r <= {entries})"""]
    for k in range(rounds + 1):
        # Distance and entry in one number, so that the least one breaks ties to the lower entry.
        steps.append(f"""
    near{k} as materialized (
        select r, part, min(d * {entries} + entry) as best
        from (select num.r, num.part, b.entry, sum((v - c) * (v - c)) as d
              from num join book{k} b on b.part = num.part and b.pos = num.pos group by all)
        group by r, part
    )""")
        if k < rounds:
            steps.append(f"""
    mean{k} as (
        select num.part, best % {entries} as entry, pos, sum(v) as s, count(*) as n
        from num join near{k} a on a.r = num.r and a.part = num.part group by all
    ),
    book{k + 1} as materialized (
        select b.part, b.entry, b.pos, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), b.c) as c
        from book{k} b left join mean{k} m on m.part = b.part and m.entry = b.entry and m.pos = b.pos
    )""")
    steps.append(f"""
    coded as (
        select r, string_agg(printf('%02x', cast(best % {entries} as int)), '' order by part) as code,
               cast(sum(best // {entries}) as bigint) as error
        from near{rounds} group by r
    )""")
    return "with " + ",".join(steps) + f"""
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
           (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
    from kept join coded using (r)"""
