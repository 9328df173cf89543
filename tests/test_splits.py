import itertools
import random
from collections import Counter
from math import floor

import pytest
from pyspark.sql import functions as F

from clinote.operators import splits


def nearest(sizes, target):
    sums = {0}
    for s in sizes:
        sums |= {s + t for t in sums}
    return min(sums, key=lambda t: (abs(t - target), t))


@pytest.mark.parametrize("seed", range(40))
def test_counts_meet_the_target_or_come_nearest(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([1, 2, 3, 5, 8, 30, 77, 1000][draw.randrange(8):]) for _ in range(draw.randrange(1, 60))]
    classes = Counter(sizes)
    for fraction in (0.0, 0.1, 0.3, 0.5, 1.0):
        target = floor(sum(sizes) * fraction)
        counts = splits.choose_counts(classes, target)
        assert all(0 < n <= classes[s] for s, n in counts.items())
        got = sum(s * n for s, n in counts.items())
        assert abs(got - target) == abs(nearest(sizes, target) - target)


def test_counts_of_very_many_groups():
    classes = {s: 10**9 // s for s in range(1, 400)}
    target = floor(0.3 * sum(s * n for s, n in classes.items()))
    counts = splits.choose_counts(classes, target)
    assert sum(s * n for s, n in counts.items()) == target
    assert all(abs(counts[s] / classes[s] - 0.3) < 0.01 for s in classes)


def test_large_sizes_alone():
    """No share is right: 3 of 10^6 and 7 of 999,983 rows, of which a third is wanted."""
    classes = {10**6: 3, 999_983: 7}
    for target in (3 * 10**6, 4 * 999_983, 2 * 10**6 + 999_983, 123):
        counts = splits.choose_counts(classes, target)
        sums = [a * 10**6 + b * 999_983 for a, b in itertools.product(range(4), range(8))]
        assert abs(sum(s * n for s, n in counts.items()) - target) == min(abs(t - target) for t in sums)


def test_a_bounded_search_still_comes_near():
    classes = {s: 50 for s in range(1000, 1400)}
    target = floor(0.3 * sum(s * n for s, n in classes.items()))
    counts = splits.choose_counts(classes, target, max_bits=1 << 22)
    assert all(n <= 50 for n in counts.values())
    assert abs(sum(s * n for s, n in counts.items()) - target) < 1400


def test_whole_groups_and_the_exact_share(spark):
    draw = random.Random(3)
    rows = [(k, g) for g in range(300) for k in range(draw.choice([1, 1, 2, 7, 40]))]
    rows += [(k, None) for k in range(2000)]
    df = spark.createDataFrame([(k, g, "x", 1) for k, g in rows], "key int, note long, size string, draw int")
    out = splits.split_by_group_exactly(df, "note", test_fraction=0.3)
    assert out.columns == ["key", "note", "size", "draw", "split"]
    sides = {}
    for r in out.collect():
        sides.setdefault(r["note"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and out.count() == len(rows)
    assert out.filter("split = 'test'").count() == floor(len(rows) * 0.3)
    again = splits.split_by_group_exactly(df.repartition(5), "note", test_fraction=0.3)
    assert {r["note"] for r in again.filter("split = 'test'").collect()} == {n for n, s in sides.items() if s == {"test"}}
    other = splits.split_by_group_exactly(df, "note", test_fraction=0.3, seed="1")
    assert {r["note"] for r in other.filter("split = 'test'").collect()} != {n for n, s in sides.items() if s == {"test"}}


def test_odd_shares(spark):
    df = spark.createDataFrame([(g,) for g in (1, 1, 1, 2, 2, 2)], "note long")
    count = lambda f: splits.split_by_group_exactly(df, "note", test_fraction=f).filter("split = 'test'").count()
    assert [count(f) for f in (0.0, 0.2, 0.5, 1.0)] == [0, 0, 3, 6]
    assert splits.split_by_group_exactly(df.filter("false"), "note").count() == 0
    assert splits.split_by_group_exactly(df.select(F.col("note").alias("key")), "key", test_fraction=0.5).count() == 6
    with pytest.raises(ValueError):
        splits.split_by_group_exactly(df, "note", test_fraction=1.2)
