"""Exact train/test split by whole groups: a subset-sum over size classes, drawn by seeded digests.

Groups of one size are alike, so only the sizes and how many groups have them reach the driver: of n rows at
most the square root of 2n sizes differ. How many groups of each size go to the test side is found so that their rows sum
to the wanted number; which ones is drawn by digest, in parallel.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import floor

from pyspark.sql import DataFrame, Window, functions as F

from clinote.functions.ranking import BUCKET_DIGITS
from clinote.session import store

#: Bits that one search may hold; the search widens up to here.
MAX_BITS = 1 << 33


def _nearest(items: list[tuple[int, int]], target: int, reach: int) -> tuple[int, dict[int, int]]:
    """The sum of ``(size, most)`` items that is nearest to the target (a tie: the smaller), and how many of each give it."""
    sums, steps, limit = 1, [], (1 << (reach + 1)) - 1
    for size, most in items:
        # Powers of two of an item, so that few steps stand for many equal groups.
        part = 1
        while most:
            n = min(part, most)
            steps.append((size, n, sums))
            sums = (sums | sums << size * n) & limit
            most, part = most - n, 2 * part
    below = (sums & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = sums >> (target + 1)
    found = below
    if above:
        least = target + (above & -above).bit_length()
        if below < 0 or least - target < target - below:
            found = least
    rest, chosen = found, {}
    for size, n, before in reversed(steps):
        if not before >> rest & 1:
            rest -= size * n
            chosen[size] = chosen.get(size, 0) + n
    return found, chosen


def choose_counts(classes: Mapping[int, int], target: int, max_bits: int = MAX_BITS) -> dict[int, int]:
    """How many groups of each size to take so that their sizes sum to the target, or come nearest to it.

    ``classes`` has the number of groups of each size. Every class gives its share but for a few groups, and
    these are searched for the exact sum; where there is none, the search widens to more groups, at last to all. It ends
    sooner only where it would hold more than ``max_bits`` bits, with the nearest sum found by then.
    """
    classes = {s: n for s, n in classes.items() if s > 0 and n > 0}
    total = sum(s * n for s, n in classes.items())
    target = max(0, min(target, total))
    if not classes or not target:
        return {}
    best: tuple[int, dict[int, int]] | None = None
    slack = 2
    while True:
        base = {s: max(0, n * target // total - slack) for s, n in classes.items()}
        room = {s: min(n, n * target // total + slack) - base[s] for s, n in classes.items()}
        rest = target - sum(s * n for s, n in base.items())
        reach = min(sum(s * n for s, n in room.items()), rest + max(classes))
        steps = sum(n.bit_length() for n in room.values())
        if best is not None and reach * steps > max_bits:
            return best[1]
        if reach * steps <= max_bits or len(classes) == 1:
            # Large sizes first, so that the sums held at the begin are few.
            found, more = _nearest(sorted(room.items(), reverse=True), rest, reach)
        else:
            # Too many sizes for one search: the smallest ones reach any sum that can be reached, most of the time.
            small, bits = [], 0
            for s in sorted(room):
                bits += s * room[s]
                if small and bits * sum(n.bit_length() for _, n in small) > max_bits:
                    break
                small.append((s, room[s]))
            base = {s: n + (room[s] // 2 if s not in dict(small) else 0) for s, n in base.items()}
            rest = target - sum(s * n for s, n in base.items())
            found, more = _nearest(sorted(small, reverse=True), max(0, rest), min(bits, max(0, rest) + small[-1][0]))
        counts = {s: base[s] + more.get(s, 0) for s in classes if base[s] + more.get(s, 0)}
        off = abs(rest - found)
        if best is None or off < best[0]:
            best = (off, counts)
        if off == 0 or all(room[s] == n for s, n in classes.items()):
            return best[1]
        slack *= 8


def split_by_group_exactly(
    rows: DataFrame, group: str, *, test_fraction: float = 0.3, seed: str = "0", digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add ``split``: whole groups are ``test`` or ``train``, and floor(n * test_fraction) rows are test.

    Exactly as many wherever groups with that many rows exist, else the nearest number. Rows without a group are one
    group. Equal tables split alike, however their rows lie.
    """
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError("test_fraction must lie between 0 and 1")
    spark = rows.sparkSession
    groups = rows.groupBy(F.col(f"`{group}`").alias("key")).agg(F.count("*").alias("size"))
    named = F.coalesce(F.col("key").cast("string"), F.lit(""))
    groups = groups.withColumn("draw", F.sha1(F.concat_ws("|", F.lit(seed), named, F.col("key").isNull().cast("string"))))
    groups = groups.withColumn("bucket", F.left("draw", F.lit(digits)))
    groups = store(spark, groups, "split-groups")
    classes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(s * n for s, n in classes.items())
    counts = choose_counts(classes, floor(total * test_fraction))
    wanted = spark.createDataFrame(sorted(counts.items()), "size long, wanted long")
    # The groups of a size in the order of their draws: buckets first, then inside them.
    sized = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("size", "bucket", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("draw", "key"))
    test = (
        groups.withColumn("place", inside).join(offsets, ["size", "bucket"]).join(wanted, "size")
        .filter(F.col("before") + F.col("place") <= F.col("wanted"))
        .select(F.col("key").alias("__test"), F.lit(True).alias("__is_test"))
    )
    return rows.join(test, F.col(f"`{group}`").eqNullSafe(F.col("__test")), "left").withColumn(
        "split", F.when(F.col("__is_test"), "test").otherwise("train")
    ).drop("__test", "__is_test")
