"""Operators 11 and 13: mixes against their targets and exact draws, divergences against SQL and plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from clinote.llm import queries, source_audit, source_mixing

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size string, row int, n long, number string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names an operator might use."""
    return spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Share by weight, stop at the limit, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        given = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if given[s] > repeats * sizes[s] + 1e-9}
        if not above:
            return {**{s: repeats * sizes[s] for s in full}, **given}
        full |= above


def random_documents(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = draw.choice([0, 1, 3, 40, 400])
        text = draw.choice([" ", "\n\t", "  "]).join(f"w{draw.randrange(50)}" for _ in range(words))
        rows.append((i, text, draw.choice(["en", "de", None]), draw.choice(["a", "a", "a", "b", "Z", "é", None])))
    return rows


def test_targets_are_those_of_sharing_again(spark):
    draw = random.Random(3)
    for n in (1, 2, 3, 8):
        sizes = {**{f"s{k}": draw.choice([0, 5, 100, 2000]) for k in range(n)}, None: 70}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in source_mixing.targets(rows).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


@pytest.mark.parametrize("total, marked, drawn", [(10, 4, 5), (40, 39, 3), (30, 1, 29), (7, 7, 3), (7, 0, 3), (1, 1, 0)])
def test_draws_follow_the_hypergeometric_distribution(spark, total, marked, drawn):
    """At evenly spread uniform numbers each value comes as often as its exact probability says."""
    n = 4000
    numbers = spark.range(n).select(source_mixing.hypergeometric(
        F.lit(total).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long"), (F.col("id") + 0.5) / n
    ).alias("k"))
    got = {r["k"]: r["count"] for r in numbers.groupBy("k").count().collect()}
    for k in range(total + 1):
        ways = math.comb(marked, k) * math.comb(total - marked, drawn - k) if k <= drawn else 0
        assert abs(got.get(k, 0) - n * ways / math.comb(total, drawn)) <= 1.5


def test_a_large_draw_stays_near_its_mean(spark):
    row = spark.range(1).select(source_mixing.hypergeometric(
        F.lit(3_000_000).cast("long"), F.lit(1_000_000).cast("long"), F.lit(1_500_000).cast("long"), F.lit(0.5)
    ).alias("k")).first()
    assert abs(row["k"] - 500_000) <= 1


@pytest.mark.parametrize("n_shards", [1, 2, 5, 8])
def test_quotas_are_split_exactly(spark, n_shards):
    blocks = [17, 0, 300, 1, 52]
    quotas = spark.createDataFrame(list(enumerate(blocks)), "number int, blocks long")
    rows = source_mixing.split_quotas(quotas, n_shards).collect()
    per_shard, ranges = Counter(), defaultdict(list)
    for r in rows:
        per_shard[r["shard"]] += r["quota"]
        ranges[r["number"]].append((r["first"], r["first"] + r["quota"]))
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) == n_shards
    for number, held in ranges.items():  # disjoint, without gaps
        assert [p for a, b in sorted(held) for p in range(a, b)] == list(range(blocks[number]))
    assert source_mixing.split_quotas(quotas.filter("false"), n_shards).count() == 0


def test_shares_of_shards_vary_as_drawn(spark):
    """The variance of a source's share over the shards is that of the multivariate hypergeometric distribution."""
    shares = []
    quotas = spark.createDataFrame([(0, 400), (1, 400)], "number int, blocks long")
    for seed in range(3):
        rows = source_mixing.split_quotas(quotas, 64, seed=seed).filter("number = 0").collect()
        shares += [r["quota"] for r in rows] + [0] * (64 - len(rows))
    drawn = 800 / 64
    variance = drawn * 0.25 * (800 - drawn) / 799
    assert sum((s - drawn / 2) ** 2 for s in shares) / len(shares) == pytest.approx(variance, rel=0.35)


def test_mix_of_odd_rows(spark):
    rows = random_documents(150, 5) + [
        (None, "a b", "en", "a"), (None, "a b", "en", "a"), (7, "again other", "en", "b"), (7, None, None, "b"),
        (900, "long " * 30_000, "en", "Z"), (901, "", "en", "only empty"), (902, " x  y", "en", "b"),
    ] + [(903, "same words here", "de", "é")] * 9000
    made = source_mixing.mix(frame(spark, rows), block_words=50, shard_blocks=40)
    out = source_mixing.taken_words(made).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert Counter((r["key"], r["size"]) for r in out) == Counter((i, size(t)) for i, t, _, _ in rows)
    sizes = Counter()
    for _, text, _, origin in rows:
        sizes[origin] += size(text)
    want = plain_targets(sizes)
    number = {r["source"]: r["number"] for r in made.sources.collect()}
    taken = Counter()
    for r in made.pieces.collect():
        assert 0 <= r["first_word"] < r["last_word"]
        taken[r["number"]] += r["last_word"] - r["first_word"]
    assert {s: taken[number[s]] for s in sizes} == {s: math.floor(want[s] + 1e-6) for s in sizes}
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert Counter(r["taken"] for r in source_mixing.taken_words(made).collect()) == Counter(r["taken"] for r in out)


def test_mix_is_the_same_on_other_partitions(spark):
    df = frame(spark, random_documents(80, 2))
    first, other = (
        sorted(map(repr, source_mixing.mix(d, block_words=30, shard_blocks=8).pieces.collect()))
        for d in (df.repartition(1), df.repartition(7))
    )
    assert first == other


def test_mix_writes_its_words(spark, tmp_path):
    rows = [(i, f"d{i} " + " ".join(f"d{i}.{k}" for k in range(i % 9)), "en", "ab"[i % 2]) for i in range(40)]
    df = frame(spark, rows)
    made = source_mixing.mix(df, block_words=7, shard_blocks=5)
    source_mixing.write(df, made, str(tmp_path / "mix"))
    words = Counter(w for r in spark.read.parquet(str(tmp_path / "mix")).collect() for w in r["text"].split())
    per_document = Counter()
    for word, n in words.items():
        assert n <= 2
        per_document[int(word[1:].split(".")[0])] += n
    assert per_document == Counter({r["key"]: r["taken"] for r in source_mixing.taken_words(made).collect() if r["taken"]})


def test_mix_of_nothing(spark):
    assert source_mixing.taken_words(source_mixing.mix(frame(spark, []))).count() == 0
    empty = source_mixing.taken_words(source_mixing.mix(frame(spark, [(1, None, None, None), (2, " ", "en", "a")])))
    assert sorted(tuple(r) for r in empty.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_op11_query(spark):
    out = queries.op11_source_mixing(spark, SF_DIR).collect()
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in documents}
    source = {r["doc_id"]: r["source"] for r in documents}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    want = plain_targets(sizes)
    for r in out:
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    assert len(out) == len(documents) and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_op11_stays_in_the_jvm(spark, capsys):
    queries.op11_source_mixing(spark, SF_DIR).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def plain_audit(rows, min_documents=3, top=200):
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_documents]
        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        value = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-value(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda f: (f[0], f[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (None, "The the THE straße STRASSE É é", "en", "b"), (3, "the. É\x00x 你好 你好", "en", "a"),
    (3, "the. É\x00x 你好 你好", "en", "a"), (4, "the é 你好 x x x", "en", "c"), (5, "the", "en", None), (6, "K k K the", "", "d"),
    (7, "one two", "de", "a"), (8, "one", "de", "b"), (9, "one", "de", "c"), (10, "123 ._-", "nothing", "z"), (11, "x y " * 20_000, "en", "a"),
]


@pytest.mark.parametrize("held", [2, 400_000])
@pytest.mark.parametrize("partitions", [1, 5])
def test_audit_of_odd_rows(spark, held, partitions):
    df = frame(spark, ODD).repartition(partitions)
    out = source_audit.audit(df, held_entries=held)
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(ODD)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert source_audit.audit(df.filter("false")).count() == 0


def test_audit_keeps_the_best_terms(spark):
    draw = random.Random(8)
    rows = [
        (i, " ".join("t" + "abcdefghij"[draw.randrange(10)] * draw.randrange(1, 60) for _ in range(300)), "en", "ab"[i % 2])
        for i in range(40)
    ]
    out = source_audit.audit(frame(spark, rows).repartition(6), top_terms=20)
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(rows, top=20)


def test_shares_of_large_counts_are_exact():
    import numpy as np
    counts = np.array([[9_000_000_001, 5], [10**13, 0]], dtype=np.int64)
    got = source_audit._share(counts, np.array([10**14 + 7, 9]))
    assert got.tolist() == [[1 + 10**9 * (n + 1) // b for n, b in zip(row, (10**14 + 7, 9))] for row in counts.tolist()]


def test_op13_against_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
        want = sorted(db.sql(queries.ORACLE_SQL["op13_source_audit"]).fetchall())
    assert sorted(tuple(r) for r in queries.op13_source_audit(spark, SF_DIR).collect()) == want
