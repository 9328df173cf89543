import pytest
from pyspark.sql import functions as F

from clinote.sources import registry

KEY = ["note_id", "offset"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "note_id long, offset string, other string")


def test_numbers_go_on_without_gaps(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.high_water_mark(spark, path) == 0
    first = frame(spark, [(k, str(k % 3), "a") for k in range(50)] + [(7, "1", "again"), (None, "x", "a"), (None, None, "a")])
    one = {(r["note_id"], r["offset"]): r["id"] for r in registry.number_keys(first, KEY, path, "id").collect()}
    assert sorted(one.values()) == list(range(1, 53)) and registry.high_water_mark(spark, path) == 52
    again = registry.number_keys(first.repartition(4), KEY, path, "id")
    assert {(r["note_id"], r["offset"]): r["id"] for r in again.collect()} == one and again.count() == 53
    assert registry.high_water_mark(spark, path) == 52
    more = frame(spark, [(k, str(k % 3), "b") for k in range(40, 90)])
    two = {(r["note_id"], r["offset"]): r["id"] for r in registry.number_keys(more, KEY, path, "id").collect()}
    assert all(two[k] == one[k] for k in two.keys() & one.keys())
    assert sorted({*one.values(), *two.values()}) == list(range(1, 93))


def test_an_interrupted_load_does_not_count(spark, tmp_path):
    path = tmp_path / "registry"
    registry.number_keys(frame(spark, [(1, "a", "")]), KEY, str(path), "id")
    broken = path / "upto=3"
    spark.createDataFrame([(9, "z", 2), (8, "z", 3)], "note_id long, offset string, id long").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert registry.high_water_mark(spark, str(path)) == 1
    out = registry.number_keys(frame(spark, [(2, "b", ""), (3, "c", "")]), KEY, str(path), "id")
    assert sorted(r["id"] for r in out.collect()) == [2, 3]
    assert registry.known(spark, str(path), "note_id long, offset string, id long").count() == 3


def test_an_empty_load(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.number_keys(frame(spark, []), KEY, path, "id").count() == 0
    assert registry.high_water_mark(spark, path) == 0


def test_collisions_are_reported(spark):
    rows = frame(spark, [(1, "a", "x"), (1, "a", "y"), (2, "b", "")])
    assert registry.hash_collisions(rows, KEY).count() == 0
    # xxhash64 passes over nulls, so these keys share a hash.
    same = frame(spark, [(None, "a", ""), (None, "a", "")]).unionByName(frame(spark, [(5, None, "")]))
    assert registry.hash_collisions(same.withColumn("more", F.lit(None).cast("string")), KEY).count() == 0
    pair = spark.createDataFrame([("a", None), (None, "a")], "one string, two string")
    assert [r["n_keys"] for r in registry.hash_collisions(pair, ["one", "two"]).collect()] == [2]


@pytest.fixture
def loaded(spark, tmp_path):
    path = str(tmp_path / "note_nlp")
    schema = "note_id long, term string"

    def load(rows, notes):
        df = spark.createDataFrame(rows, schema)
        registry.replace_notes(df, spark.createDataFrame([(n,) for n in notes], "note_id long"), path, n_buckets=4)
        out = registry.read_notes(spark, path, schema)
        assert out.columns == ["note_id", "term"]
        return sorted((r["note_id"], r["term"]) for r in out.collect())

    return load


def test_loads_replace_whole_notes(loaded):
    first = [(n, t) for n in range(30) for t in ("a", "b")]
    assert loaded(first, range(30)) == sorted(first)
    assert loaded(first, range(30)) == sorted(first)
    second = [(3, "c"), (40, "a"), (40, "a")]
    kept = [r for r in first if r[0] not in (3, 5)]
    assert loaded(second, [3, 5, 40]) == sorted(kept + second)
    assert loaded(second, [3, 5, 40]) == sorted(kept + second)
    assert loaded([], range(50)) == []
    assert loaded([(None, "x"), (1, "y")], [1, None]) == [(1, "y")]
