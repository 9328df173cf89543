"""Jaccard join of documents on word shingles with Bayesian pruning (operator 5).

1. Every text becomes a MinHash signature and a digest of its shingle set; texts of one set
   are one class with a representative, so exact copies meet no more after this.
2. Signatures are banded into buckets. In a bucket, signatures are compared a few values at
   a time, and a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold, given the matches so far, falls below a tolerance.
3. The pairs left connect representatives to neighbourhoods; within each, all pairs are
   verified exactly on their shingle sets, and the links counted.

Pairs never become rows: a task takes two chunks of a bucket or neighbourhood, of bounded
size, and gives back counts and a spanning forest. So no bucket or group of near copies
is ever in one task, and what is shuffled grows with the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clinote.llm.components import connected_components
from clinote.llm.workers import map_batches, slices
from clinote.llm.words import mix, shingles
from clinote.session import store

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no bucket with a probability of 3e-6
STEP = 16  # signature values per look
CHUNK_ROWS = 512
CHUNK_BYTES = 16 << 20
_SLICE_BYTES = 2 << 20
_PAIRS_AT_ONCE = 1 << 20


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n] | np.uint64(1), numbers[n:]


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, texts x ``n`` (32 bit); every text needs a shingle."""
    out = np.empty((len(counts), n), dtype=np.uint32)
    starts, (factor, add) = np.cumsum(counts) - counts, _factors(n)
    for k in range(n if len(counts) else 0):
        out[:, k] = np.minimum.reduceat(((hashes * factor[k] + add[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def fewest_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Matches among ``seen`` values below which the posterior of the threshold is under the tolerance.

    With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum.
    """
    total = 0.0
    for m in range(seen + 1):
        total += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen + 1


def likely_pairs(
    signature: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay likely to reach the threshold as more values are compared."""
    matches, n = np.zeros(len(left), dtype=np.int64), signature.shape[1]
    for low in range(0, n, STEP):
        high = min(low + STEP, n)
        matches += (signature[left, low:high] == signature[right, low:high]).sum(axis=1)
        keep = matches >= fewest_matches(high, threshold, tolerance)
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(c[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py() for c, k in zip(columns, keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            last = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    columns = [table.column(k).to_numpy() for k in keys]
    changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    bounds = [0, *changes.tolist(), table.num_rows]
    return list(zip(bounds, bounds[1:]))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        if (label[left] == low).all() and (label[right] == low).all():
            break
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
    return label


def _unit_pairs(sizes: list[int], in_first: list[np.ndarray], alone: list[bool], start: list[int]):
    """All pairs of the units of a batch: within a chunk, or between its two chunks."""
    for size, first, single, at in zip(sizes, in_first, alone, start):
        if single:
            left, right = np.triu_indices(size, 1)
        else:
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        yield left + at, right + at


def _in_chunks(members: DataFrame, key: str, chunks: str) -> DataFrame:
    """Rows of ``members`` with ``unit, i, j``: once for every pair of chunks that holds the row's.

    A row's chunk is decided by its ``rep``; ``own`` tells its chunk.
    """
    own = F.pmod(F.xxhash64("rep"), F.col(chunks)).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(chunks).cast("int") - 1)))
        .withColumns({"unit": F.col(key), "i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other")
    )


def _sketch(df: DataFrame, words: int) -> DataFrame:
    """``id, hash, n, d1, d2, sig`` of ``id, text, hash``: shingles, digest of their set, signature; null where there are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE_BYTES):
            hashes, counts = shingles(batch.column(1), words)
            full = counts > 0
            made = signatures(hashes, counts[full], BANDS * ROWS)
            starts = (np.cumsum(counts) - counts)[full]
            sums = [np.add.reduceat(mix(hashes, seed), starts) if len(starts) else np.empty(0, np.uint64)
                    for seed in (1, 2)]
            place = iter(range(len(made)))
            rows = [next(place) if f else None for f in full.tolist()]
            digests = [s.view(np.int64).tolist() for s in sums]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts),
                 *[pa.array([None if r is None else d[r] for r in rows], pa.int64()) for d in digests],
                 pa.array([None if r is None else made[r].tobytes() for r in rows], pa.binary())],
                names=["id", "hash", "n", "d1", "d2", "sig"],
            )

    return map_batches(df, run, "id long, hash long, n long, d1 long, d2 long, sig binary")


def _band_keys(representatives: DataFrame) -> DataFrame:
    """``key, rep``: a row per band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])

    return map_batches(representatives.select("rep", "sig"), run, "key long, rep long")


def _likely_links(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``a, b``: a spanning forest of the likely pairs of each unit."""
    def judge(table: pa.Table, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        reps = table.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        pairs = _unit_pairs(
            [b - a for a, b in bounds], [own[a:b] == i[a] for a, b in bounds],
            [i[a] == j[a] for a, _ in bounds], [a for a, _ in bounds],
        )
        found, pending, held = [], [], 0
        for left, right in pairs:
            pending.append((left, right))
            held += len(left)
            if held >= _PAIRS_AT_ONCE:
                found.append(likely_pairs(sig, *map(np.concatenate, zip(*pending)), threshold, tolerance))
                pending, held = [], 0
        if pending:
            found.append(likely_pairs(sig, *map(np.concatenate, zip(*pending)), threshold, tolerance))
        left, right = map(np.concatenate, zip(*found))
        # Units do not mix: a representative may lie in several, each with a place of its own.
        label = forest(len(reps), left, right)
        moved = np.flatnonzero(label != np.arange(len(reps)))
        return reps[moved], reps[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["unit", "i", "j"]):
            a, b = judge(table, group_bounds(table, ["unit", "i", "j"]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return map_batches(_sorted(units.select("unit", "i", "j", "own", "rep", "sig")), run, "a long, b long")


def _sorted(units: DataFrame) -> DataFrame:
    return units.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")


def _overlaps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles that each two texts have in common."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    sorted_hashes, owner = hashes[order], owner[order]
    new = np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])
    feature = np.cumsum(new) - 1
    shared = (np.bincount(feature) > 1)[feature]
    feature, owner = np.unique(feature[shared], return_inverse=True)[1], owner[shared]
    common = np.zeros((len(counts), len(counts)), dtype=np.float32)
    width = 4096
    bounds = np.searchsorted(feature, np.arange(0, (int(feature[-1]) + 1 if len(feature) else 0) + width, width))
    for block, (a, b) in enumerate(zip(bounds, bounds[1:])):
        held = np.zeros((len(counts), width), dtype=np.float32)
        held[owner[a:b], feature[a:b] - block * width] = 1
        common += held @ held.T
    return common


def _verified(units: DataFrame, threshold: float, words: int) -> DataFrame:
    """``rep, links, parent``: per unit, documents linked to each text exactly, and a spanning forest."""
    def judge(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = table.slice(a, b - a)
        reps, copies = part.column("rep").to_numpy(), part.column("copies").to_numpy()
        hashes, counts = shingles(part.column("text").combine_chunks(), words)
        common = _overlaps(hashes, counts)
        either = counts[:, None] + counts[None, :] - common
        linked = common >= threshold * either - 1e-6 * either
        np.fill_diagonal(linked, False)
        own, i, j = (part.column(c).to_numpy() for c in ("own", "i", "j"))
        if i[0] != j[0]:
            linked &= own[:, None] != own[None, :]
        label = forest(len(reps), *np.nonzero(np.triu(linked)))
        return reps, linked @ copies, reps[label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["unit", "i", "j"]):
            table = table.combine_chunks()
            rows = [judge(table, a, b) for a, b in group_bounds(table, ["unit", "i", "j"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], names=["rep", "links", "parent"]
            )

    columns = units.select("unit", "i", "j", "own", "rep", "copies", "text")
    return map_batches(_sorted(columns), run, "rep long, links long, parent long")


def join(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS,
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``key, class_id, n_links, copy_id``: one row per document with its class and its links.

    Two documents are linked when the Jaccard similarity of their shingle sets is at least
    ``threshold``. ``n_links`` counts the other documents linked to this one, copies
    included; ``class_id`` is the smallest key of all that links connect; ``copy_id`` the
    smallest key of the same shingle set. A text of fewer than ``words`` words is one
    shingle; one without words, or null, has no links. Rows without a key are left out, and
    rows that share a key are one document, with the text of the smallest digest (of its shingles, then of itself). An empty
    table gives no rows. Further columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(key).cast("long").alias("id"), df[text].alias("text"), F.xxhash64(df[text]).alias("hash")
    ).filter(F.col("id").isNotNull())
    sketched = store(spark, _sketch(rows, words), "sketches")
    # Of rows that share a key one is chosen here, and its text's hash goes with it.
    order = F.struct("d1", "d2", "hash")
    one = sketched.groupBy("id").agg(F.min(order).alias("d")).select("id", "d.*")
    first = F.min(F.struct(F.col("id").alias("rep"), "hash")).alias("first")
    classes = one.filter("d1 is not null").groupBy("d1", "d2").agg(first, F.count("*").alias("copies"))
    classes = store(spark, classes.select("d1", "d2", "first.*", "copies"), "classes")
    signed = sketched.select(F.col("id").alias("rep"), "hash", "d1", "d2", "sig").join(classes, ["rep", "hash", "d1", "d2"])
    signed = signed.dropDuplicates(["rep"])

    # Buckets of two or more; of buckets with the same members, one.
    postings = _band_keys(signed)
    buckets = postings.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members"))
    buckets = buckets.filter("size > 1").groupBy("size", "members").agg(F.min("key").alias("key"))
    buckets = buckets.select("key", F.ceil(F.col("size") / CHUNK_ROWS).alias("chunks"))
    # Sixteen bits of a value are enough to compare; a chance match is checked exactly later.
    short = map_batches(signed.select("rep", "sig"), _shorten, "rep long, sig binary")
    members = postings.join(buckets, "key").join(short, "rep")
    likely = store(spark, _likely_links(_in_chunks(members, "key", "chunks"), threshold, tolerance), "likely-links")

    near = store(spark, connected_components(likely, "a", "b"), "neighbourhoods")
    chosen = near.withColumnRenamed("node", "rep").join(classes.select("rep", "hash", "copies"), "rep")
    texts = rows.withColumnRenamed("id", "rep").join(chosen, ["rep", "hash"]).drop("hash")
    sizes = texts.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.octet_length("text")).alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK_ROWS), F.ceil(F.col("bytes") / CHUNK_BYTES))
    members = texts.join(sizes.select("component", chunks.alias("chunks")), "component").dropDuplicates(["rep"])
    verified = store(spark, _verified(_in_chunks(members, "component", "chunks"), threshold, words), "verified-links")
    linked = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.select("rep", "parent"), "rep", "parent").toDF("rep", "class_id")

    of_class = classes.join(linked, "rep", "left").join(joined, "rep", "left").select(
        "d1", "d2", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return one.join(of_class, ["d1", "d2"], "left").select(
        F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "id").alias("copy_id"),
    )


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [np.frombuffer(s, np.uint32).astype(np.uint16).tobytes() for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["rep", "sig"])


def keep_first(df: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all columns, less those linked to a document of a smaller key.

    One document of each class stays. Rows without a key are kept, as they are not judged.
    """
    judged = join(df, key=key, text=text, **options)
    dropped = judged.filter(F.col(key) != F.col("class_id")).select(F.col(key).alias("__dropped"))
    return df.join(dropped, df[key] == dropped["__dropped"], "left_anti")
