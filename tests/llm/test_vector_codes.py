"""Operator 12: codes against SQL and against a plain version in Python's integers."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from clinote.llm import queries, vector_codes
from clinote.llm.vector_codes import hilbert_order

SF_DIR = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not usable:
        return []
    lengths = Counter(len(r[1]) for r in usable)
    length = max(lengths, key=lambda n: (lengths[n], n))
    usable = [r for r in usable if len(r[1]) == length]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(math.ldexp(1, 12) * x) if abs(x) < 1e300 else int(x) * scale for x in r[1]] for r in usable]
    bounds = [k * length // parts for k in range(parts + 1)]
    cut = [[tuple(v[a:b]) for a, b in zip(bounds, bounds[1:])] for v in whole]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((x - c) ** 2 for x, c in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in cut:
                met.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for e, held in met.items():
                books[p][e] = tuple(sum(column) // len(held) for column in zip(*held))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    top = (1 << 63) - 1
    errors = [min(sum(d for d, _ in f), top) for f in found]
    labels = Counter()
    for r, e in zip(usable, errors):
        labels[r[2]] += e
    return sorted(
        ((r[0], "".join(f"{e:02x}" for _, e in f), error, min(labels[r[2]], top), digest)
         for r, f, error in zip(usable, found, errors)), key=repr)


def frame(spark, rows, kind="float"):
    schema = f"vec_id long, embedding array<{kind}>, label int, code string, keys int, error int"
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def random_rows(n, length, seed, labels=(0, 1, None)):
    draw = random.Random(seed)
    return as_floats([
        (i, [draw.gauss(0, 0.3) + (i % 5) * 0.2 for _ in range(length)], draw.choice(labels)) for i in range(n)
    ])


@pytest.mark.parametrize("n, length", [(300, 16), (40, 64), (5, 8), (60, 20), (30, 3), (1, 8)])
def test_codes_against_a_plain_version(spark, n, length):
    rows = random_rows(n, length, n)
    out = vector_codes.compress(frame(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)


def test_odd_rows(spark):
    rows = random_rows(50, 8, 1) + as_floats([
        (None, [0.5] * 8, None), (3, [0.1] * 8, 1), (3, [0.1] * 8, 1), (3, [-0.7] * 8, 1), (60, None, 1),
        (61, [0.0] * 7 + [None], 1), (62, [NAN] + [0.0] * 7, 1), (63, [INF] + [0.0] * 7, 0), (64, [], 0), (65, [1.0, 2.0], 0),
        (-9, [-INF] * 8, 0), (-8, [0.25, -0.0, 0.0, 1e-30, -1e-30, 0.25, 0.25, 0.25], 0),
    ]) + [(100 + i, [0.5] * 8, 7) for i in range(500)]
    out = vector_codes.compress(frame(spark, rows).repartition(4))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("size", [3e4, 1e9, 1e30])
def test_large_components_are_exact(spark, size):
    draw = random.Random(2)
    rows = as_floats([(i, [draw.uniform(-size, size) for _ in range(8)], i % 2) for i in range(40)])
    out = vector_codes.compress(frame(spark, rows).repartition(2))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows)


def test_nothing_usable(spark):
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [None], 1)])).count() == 0


def test_partitions_and_run_sizes_do_not_matter(spark, monkeypatch):
    rows = random_rows(700, 16, 4)
    first = sorted(tuple(r) for r in vector_codes.compress(frame(spark, rows).coalesce(1)).collect())
    monkeypatch.setattr(vector_codes, "RUN_ROWS", 90)
    assert sorted(tuple(r) for r in vector_codes.compress(frame(spark, rows).repartition(5)).collect()) == first


def test_shortlists_are_sound_and_save_work():
    draw = np.random.default_rng(0)
    numbers = vector_codes.scaled(draw.normal(0, 0.2, (4000, 4)) + draw.integers(0, 6, (4000, 1)))
    part = vector_codes._Part(numbers[hilbert_order(numbers)])
    book = numbers[:16]
    listed = part.shortlists(book)
    distance = ((part.numbers[:, None, :] - book[None]) ** 2).sum(2)
    best = distance.argmin(1)
    block = np.repeat(np.arange(len(part.sizes)), part.sizes)
    assert listed[block, best].all()
    assert listed.mean() < 0.5
    count, total = part.totals(book)
    assert count.tolist() == np.bincount(best, minlength=16).tolist()
    assert all(total[e].tolist() == part.numbers[best == e].sum(0).tolist() for e in range(16))


@pytest.mark.parametrize("bits, axes", [(3, 2), (2, 3)])
def test_the_curve_steps_to_neighbours(bits, axes):
    """Over a full grid whose corners fix the scale, each step of the order changes one axis by one."""
    side = np.arange(1 << 10 if axes == 1 else (1 << bits))
    grid = np.stack(np.meshgrid(*[side] * axes, indexing="ij"), -1).reshape(-1, axes)
    steps = np.abs(np.diff(grid[hilbert_order(grid)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_decoding_gives_entries(spark):
    df = frame(spark, random_rows(64, 16, 9))
    codes = vector_codes.train(df)
    kinds = [df.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    for r in vector_codes.encode(codes, spark, "vec_id", *kinds).collect():
        back = vector_codes.decode(codes, r["code"])
        whole = [math.floor(4096 * x) for x in vectors[r["vec_id"]]]
        assert sum((round(4096 * b) - w) ** 2 for b, w in zip(back, whole)) == r["error"]


def test_op12_against_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view embeddings as select * from '{SF_DIR}/embeddings.parquet'")
        want = sorted(db.sql(queries.ORACLE_SQL["op12_vector_codes"]).fetchall())
    assert sorted(tuple(r) for r in queries.op12_vector_codes(spark, SF_DIR).collect()) == want
