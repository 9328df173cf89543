"""Token-id archives with a minimal perfect hash index (operator 8).

An archive is a folder of three Parquet tables, written and read by Spark:

* ``payload``: raw little-endian 16-bit ids in blocks of a few megabytes, documents in
  ascending key order across shards and blocks, each closed by the end id. Columns
  ``shard, block, n_ids, keys, offsets, payload``; ``offsets`` are the documents' starts in
  the block, in ids.
* ``index``: one row per bucket of keys (a hash decides). A minimal perfect hash maps a
  key to a slot; a stored 32-bit fingerprint tells keys of the archive from others; the
  slot holds ``shard, block, offset, n_ids``.
* ``shards``: ``shard, first_id``, the number of ids in all shards before.

Access to a key takes one bucket row, one slot and one block. Shards, blocks and buckets
have bounded sizes, so their number grows with the data.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clinote.llm.pieces import PieceStore, group_sums
from clinote.llm.tables import ranges
from clinote.llm.workers import map_batches, slices

#: Text that is cut and encoded at a time.
_CALL_BYTES = 2 << 20
#: A private-use character that parts pieces within one call of the library.
_PART = ""
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Marks that may close a piece; with the apostrophe or ``<``, ``|``, ``>`` they could belong to what stands before.
_MARKS = ".,!?;:%&#$@*"
#: Letters and digits, Latin and Cyrillic, that stay one letter or digit when normalised and lower-cased.
_FIRM = frozenset(
    c for c in map(chr, [*range(0x250), *range(0x400, 0x460)])
    if c.isalnum() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c.lower()) == c.lower()
)


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts of a word-level vocabulary.

    The vocabulary drops white space, so the ids of a text are those of its pieces between
    blanks and line ends. It lower-cases, and parts marks from letters and digits, so a
    piece is its word and the marks behind it. Distinct parts go through the library once, many in a call;
    ``max_known`` of them are remembered.
    """

    def __init__(self, path: str, max_known: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self._parting = np.array(self._ids(_PART), dtype=np.int32)
        self._parts = PieceStore(self._encode, max_known)

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.utf8_rtrim(pieces, characters=_MARKS)
        firm = pc.is_in(pc.utf8_slice_codeunits(words, start=-1), value_set=pa.array(sorted(_FIRM), pieces.type))
        cut = pc.and_(pc.not_equal(words, pieces), firm)
        first = pc.if_else(cut, words, pieces)
        plain = pc.and_not(pc.string_is_ascii(first), pc.match_substring(first, "<"))
        first = pc.if_else(plain, pc.ascii_lower(first), first)
        cut_pairs = zip(pieces.filter(cut).to_pylist(), words.filter(cut).to_pylist())
        marks = pa.array([piece[len(word):] for piece, word in cut_pairs], pieces.type)
        flat, counts = self._parts.values(pa.concat_arrays([first, marks]))
        # Marks go behind their words.
        cuts = cut.to_numpy(zero_copy_only=False)
        sizes = 1 + cuts.astype(np.int64)
        ends = np.cumsum(sizes)
        order = np.empty(len(counts), dtype=np.int64)
        order[ends - sizes] = np.arange(len(pieces))
        order[ends[cuts] - 1] = len(pieces) + np.arange(len(marks))
        starts = np.cumsum(counts) - counts
        return flat[ranges(starts[order], counts[order])], group_sums(counts[order], sizes)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [p if _PART not in p else "" for p in pieces]
        parting, n = self._parting, len(self._parting)
        flats, counts = [], []
        for at in range(0, len(plain), 2000):
            group = plain[at:at + 2000]
            ids = np.array(self._ids(f" {_PART} ".join([*group, ""])), dtype=np.int32)
            hits = np.ones(max(0, len(ids) - n + 1), dtype=bool)
            for k in range(n):
                hits &= ids[k:len(ids) - n + 1 + k] == parting[k]
            ends = np.flatnonzero(hits)
            counts.append(np.diff(ends, prepend=-n) - n)
            keep = np.ones(len(ids), dtype=bool)
            for k in range(n):
                keep[ends + k] = False
            flats.append(ids[keep])
        flat, counts = np.concatenate(flats), np.concatenate(counts)
        odd = [i for i, p in enumerate(pieces) if _PART in p]
        if odd:
            ends = np.cumsum(counts)
            for i in reversed(odd):
                ids = self._ids(pieces[i])
                flat, counts[i] = np.insert(flat, ends[i], ids), len(ids)
        return flat, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number for each text; null is empty."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        split = pc.split_pattern(plain, " ")
        coded = pc.dictionary_encode(split.values)
        flat, counts = self._encode_pieces(coded.dictionary)
        places = coded.indices.to_numpy(zero_copy_only=False)
        starts, counts = (np.cumsum(counts) - counts)[places], counts[places]
        return flat[ranges(starts, counts)], group_sums(counts, np.diff(split.offsets.to_numpy()))


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).astype(np.uint64) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % 2**64)
    for shift in (30, 27, 31):
        x = (x ^ (x >> np.uint64(shift))) * _SPREAD
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys.

    Level by level, keys that have a bit of the level to themselves set it, and the others
    go on; the slot of a key is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self._before = [np.cumsum(bits) - bits for bits in levels]
        self._base = np.cumsum([0, *[int(bits.sum()) for bits in levels]])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        levels = []
        while len(keys):
            size = max(8, 2 * len(keys))
            place = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(place, minlength=size) == 1
            levels.append(bits.astype(np.int64))
            keys = keys[~bits[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that was not built in gets some slot or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place] == 1
            out[left[hit]] = self._base[level] + self._before[level][place[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<u4").tobytes()
        return head + b"".join(np.packbits(bits.astype(bool)).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", n, 4), 4 + 4 * n, []
        for size in sizes.tolist():
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(np.int64))
            at += len(packed)
        return cls(levels)


_SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("block", "<i4"), ("offset", "<i8"), ("n_ids", "<i8")])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(16)).astype(np.uint32)


def _bucket(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def write(
    df: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1,
    shard_bytes: int = 32 << 20, block_bytes: int = 4 << 20, bucket_keys: int = 4096,
) -> None:
    """Encode every text, append ``end_id`` and write the archive to ``path``.

    Null text is empty and holds the end id alone. Rows without a key are left out, as
    nothing could find them; of rows that share a key the one with the smallest text is
    kept. ``shard_bytes`` and ``block_bytes`` are of text, ``bucket_keys`` is the mean
    number of keys of an index bucket.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.filter(F.col("key").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes))
    buckets = max(1, -(-size["n"] // bucket_keys))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, None
        for batch in slices(batches, "text", block_bytes):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.append(keys[:1] != before, keys[1:] != keys[:-1]) if before is not None else \
                np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])
            batch, keys, before = batch.filter(pa.array(first)), keys[first], keys[-1]
            if not len(keys):
                continue
            made = [coder.encode(part.column(1)) for part in slices([batch], "text", _CALL_BYTES)]
            flat, counts = (np.concatenate(values) for values in zip(*made))
            ends = np.cumsum(counts + 1)
            ids = np.insert(flat, ends - 1 - np.arange(len(counts)), end_id).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([ends - counts - 1], pa.list_(pa.int64())),
                 pa.array([ids.tobytes()], pa.binary())],
                names=["shard", "block", "n_ids", "keys", "offsets", "payload"],
            )
            block += 1

    # Whole key ranges, so shards are in ascending order; equal keys meet in one.
    ranged = rows.repartitionByRange(int(shards), "key").sortWithinPartitions("key", "text")
    schema = "shard int, block int, n_ids long, keys array<long>, offsets array<long>, payload binary"
    map_batches(ranged, blocks, schema).write.option("compression", "zstd").parquet(f"{path}/payload")

    payload = spark.read.parquet(f"{path}/payload")
    totals = payload.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per shard passes through one task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id")).write.parquet(
        f"{path}/shards"
    )
    ends = F.concat(F.slice("offsets", F.lit(2), F.size("offsets")), F.array("n_ids"))
    entries = payload.select("shard", "block", F.inline(F.arrays_zip(
        F.col("keys").alias("key"), F.col("offsets").alias("offset"), ends.alias("end")
    )))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy()
        hashed = PerfectHash.build(keys)
        table = np.zeros(len(keys), dtype=_SLOT)
        slots = hashed.slots(keys)
        table["print"][slots] = _fingerprints(keys)
        for name in ("shard", "block", "offset"):
            table[name][slots] = group[name]
        table["n_ids"][slots] = group["end"] - group["offset"]
        return pd.DataFrame({
            "bucket": [int(group["bucket"].iloc[0])], "buckets": [int(buckets)],
            "hash": [hashed.to_bytes()], "slots": [table.tobytes()],
        })

    index = entries.withColumn("bucket", _bucket(int(buckets))).groupBy("bucket").applyInPandas(
        build, "bucket int, buckets int, hash binary, slots binary"
    )
    index.write.parquet(f"{path}/index")


def look_up(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """``key, shard, block, offset, n_ids`` of every distinct key that the archive holds."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    buckets = (index.agg(F.max("buckets")).first()[0]) or 1
    wanted = keys.select(F.col(key).cast("long").alias("key")).filter(F.col("key").isNotNull()).distinct()

    def find(group: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        if bucket.empty or group.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("key", "shard", "block", "offset", "n_ids")})
        hashed = PerfectHash.from_bytes(bucket["hash"].iloc[0])
        table = np.frombuffer(bucket["slots"].iloc[0], dtype=_SLOT)
        wanted_keys = group["key"].to_numpy()
        slots = hashed.slots(wanted_keys)
        known = slots >= 0
        known[known] = table["print"][slots[known]] == _fingerprints(wanted_keys[known])
        found = table[slots[known]]
        return pd.DataFrame({"key": wanted_keys[known]} | {n: found[n] for n in _SLOT.names[1:]})

    found = (
        wanted.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(find, "key long, shard int, block int, offset long, n_ids long")
    )
    return found.withColumnRenamed("key", key)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, offset, ids``: the documents as they lie in the payload, ``ids`` raw 16-bit with the end id."""
    payload = spark.read.parquet(f"{path}/payload").select("shard", "block", "n_ids", "offsets", "payload")
    ends = F.concat(F.slice("offsets", F.lit(2), F.size("offsets")), F.array("n_ids"))
    pairs = F.arrays_zip(F.col("offsets").alias("start"), ends.alias("end"))
    return payload.select("shard", "block", "payload", F.inline(pairs)).select(
        "shard", "block", F.col("start").alias("offset"),
        F.expr("substring(payload, 2 * int(start) + 1, 2 * int(end - start))").alias("ids"),
    )


def fetch(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """``key, ids`` (raw 16-bit with the end id) of every distinct key that the archive holds."""
    places = look_up(keys, path, key=key).drop("n_ids")
    return places.join(read_documents(keys.sparkSession, path), ["shard", "block", "offset"]).select(key, "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, offset, ids_crc32`` of every document, from the payload.

    The checksum is over the ids widened to 32 bits.
    """
    payload = spark.read.parquet(f"{path}/payload").select("shard", "block", "offsets", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, offsets, raw in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                ends = [*offsets[1:], len(wide) // 4]
                sums = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(offsets, ends)]
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()),
                     pa.array(offsets, pa.int64()), pa.array(sums, pa.int64())],
                    names=["shard", "block", "offset", "ids_crc32"],
                )

    return map_batches(payload, run, "shard int, block int, offset long, ids_crc32 long")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, first_id``: ids in all blocks before, over the whole archive."""
    blocks = spark.read.parquet(f"{path}/payload").select("shard", "block", "n_ids")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = spark.read.parquet(f"{path}/shards")
    return inside.join(shards, "shard").select("shard", "block", (F.col("first_id") + F.col("inside")).alias("first_id"))


def digests(keys: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` by keyed access for every distinct key of the archive."""
    spark = keys.sparkSession
    places = look_up(keys, path, key=key)
    return (
        places.join(checksums(spark, path), ["shard", "block", "offset"])
        .join(starts(spark, path), ["shard", "block"])
        .select(key, (F.col("first_id") + F.col("offset")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
    )
