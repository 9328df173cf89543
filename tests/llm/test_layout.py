"""Operators 2 and 7: laws and fewest moved bytes; archives against what was written."""

import base64
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from clinote.llm import queries, resharding, warc_archive
from clinote.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"


def test_flow_is_the_cheapest():
    """Against all whole-number flows of small cases."""
    draw = random.Random(4)
    for _ in range(30):
        n, m = draw.choice([(2, 2), (2, 3), (3, 2)])
        supply = [draw.randrange(4) for _ in range(n)]
        capacity = [draw.randrange(5) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[draw.randrange(5) for _ in range(m)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(row) for row in flow] == supply
        assert all(sum(row[j] for row in flow) <= capacity[j] for j in range(m))
        choices = [[s for s in itertools.product(range(q + 1), repeat=m) if sum(s) == q] for q in supply]
        least = min(
            sum(cost[i][j] * row[j] for i, row in enumerate(rows) for j in range(m))
            for rows in itertools.product(*choices)
            if all(sum(row[j] for row in rows) <= capacity[j] for j in range(m))
        )
        assert sum(cost[i][j] * flow[i][j] for i in range(n) for j in range(m)) == least
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], [[0]])


def placed(spark, n, olds=4):
    draw = random.Random(n)
    rows = [(i, "é" * draw.choice([0, 3, 50, 400, 9000]), "a") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    return df.withColumn("old", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % olds)), rows


def test_sizes_and_moved_bytes(spark):
    df, made = placed(spark, 3000)
    plan = resharding.plan(df, "old", 6)
    out = resharding.rewrite(df, "old", plan, scratch_path(spark, "shards")).collect()
    texts = {i: t for i, t, _ in made}
    assert sorted(r["doc_id"] for r in out) == sorted(texts) and all(r["text"] == texts[r["doc_id"]] for r in out)
    size = {i: len(t.encode()) + 8 for i, t, _ in made}
    total = sum(size.values())
    held, before = [0] * 6, [0] * 6
    for r in out:
        held[r["shard"]] += size[r["doc_id"]]
        before[r["old"]] += size[r["doc_id"]]
    assert max(held) - min(held) < 4 * 1000
    moved = sum(size[r["doc_id"]] for r in out if r["shard"] != r["old"])
    assert abs(moved - sum(max(0, b - total / 6) for b in before)) < 20 * 1000
    for shard in range(6):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_shards_that_keep_their_rows_are_not_written(spark):
    df, made = placed(spark, 400)
    size = {i: len(t.encode()) + 8 for i, t, _ in made}
    olds = {r["doc_id"]: r["old"] for r in df.collect()}
    held = [sum(size[i] for i in size if olds[i] == k) for k in range(4)]
    plan = resharding.plan(df, "old", [held[0] // 2, *held[1:], held[0]])
    assert plan.affected() == [0, 4]
    out = resharding.rewrite(df, "old", plan, scratch_path(spark, "shards"))
    assert {r["shard"] for r in out.select("shard").distinct().collect()} == {0, 4}


def whole(spark, df, plan, **options):
    """Written and untouched rows: together all rows."""
    out = resharding.rewrite(df, "old", plan, scratch_path(spark, "shards"), **options)
    return out.unionByName(resharding.untouched(df, "old", plan, **options))


def test_untouched_shards_complete_the_rows(spark):
    df, made = placed(spark, 400)
    size = {i: len(t.encode()) + 8 for i, t, _ in made}
    olds = {r["doc_id"]: r["old"] for r in df.collect()}
    held = [sum(size[i] for i in size if olds[i] == k) for k in range(4)]
    plan = resharding.plan(df, "old", [held[0] // 2, *held[1:], held[0]])
    out = whole(spark, df, plan).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, t) for i, t, _ in made)
    for shard in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


@pytest.mark.parametrize("n", [0, 1, 24, 48])
def test_op2_keeps_every_row(spark, n):
    """Rows of equal size, where shards may already hold what they shall; null and repeated keys."""
    rows = [(i, "same") for i in range(n)]
    for more in ([], [(None, "x"), (None, None), (3, "same"), (3, "same")]):
        df = spark.createDataFrame([(*r, 1, 2) for r in rows + more], "doc_id long, text string, old int, shard int")
        out = queries._resharded(df).collect()
        assert sorted([r["doc_id"] is not None, r["doc_id"] or 0, r["size"]] for r in out) == sorted(
            [i is not None, i or 0, len((t or "").encode()) + 8] for i, t in rows + more)
        for shard in range(24):
            slots = sorted(r["slot"] for r in out if r["shard"] == shard)
            assert slots == list(range(len(slots)))


def test_resharding_odd_rows(spark):
    rows = [(1, None, 0), (None, "x", None), (None, "x", 0), (2, "y", 1), (2, "y", 1), (3, "", 1), (4, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int").withColumn("block", F.lit("clash"))
    out = whole(spark, df, resharding.plan(df, "old", 3)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["old"]) for r in out) == sorted(
        (i or -1, t or "", old or 0) for i, t, old in rows)
    empty = df.limit(0)
    assert whole(spark, empty, resharding.plan(empty, "old", 3)).count() == 0


def test_resharding_of_a_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op2_min_cost_resharding(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    largest = max(r["size"] for r in found)
    held = [sum(r["size"] for r in found if r["shard"] == s) for s in range(24)]
    assert max(held) - min(held) <= largest


PAGES = [
    (5, "http://a/", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://b/", None), (4, "u", ""),
    (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 5000), (8, "u", "x" * 40_000), (8, "u", "x" * 40_000), (None, "u", "lost"),
]


def test_archive_gives_back_the_pages(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, sha1 string")
    path = scratch_path(spark, "warc")
    warc_archive.write(pages, path, segment_bytes=1000)
    payloads = {
        r["record_id"].split(":")[2]: bytes(r["payload"])
        for r in warc_archive.read(spark, path).filter("record_type = 'response'").collect()
    }
    assert payloads == {str(k): (t or "").encode() for k, _, t in PAGES if k in (2, 4, 7, 8)}
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_archive.pages(spark, path).collect()}
    assert found == {
        2: ("response", None, 11), 5: ("revisit", 2, 11), 4: ("response", None, 0), 9: ("revisit", 4, 0),
        7: ("response", None, len(PAGES[4][2].encode())), 8: ("response", None, 40_000),
    }
    small = scratch_path(spark, "warc")
    warc_archive.write(pages, small, min_revisit_bytes=12)
    assert warc_archive.pages(spark, small).filter("record_type = 'revisit'").count() == 0


def test_repeated_pages_and_odd_urls(spark):
    rows = [
        (3, "http://a/x\r\n\r\nWARC/1.1", "small"), (3, "http://a/x\r\n\r\nWARC/1.1", "small"), (3, "http://a/x", "other"),
        (1, " http://b/\t ", "one"), (1, " http://b/\t ", "one"), (1, "http://a", "one"), (5, "é", "one"), (6, "é", "small"),
        (6, "é", "small"), (6, "z", "small"), (7, "", "one"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = scratch_path(spark, "warc")
    warc_archive.write(pages, path)
    found = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0)
                   for r in warc_archive.pages(spark, path).collect())
    assert found == [
        (1, 3, "response", 0), (3, 5, "response", 0), (3, 5, "response", 0), (5, 3, "revisit", 1), (6, 5, "revisit", 3),
        (7, 3, "revisit", 1),
    ]
    records = warc_archive.read(spark, path).collect()
    assert len(records) == 6 and all(r["is_complete"] for r in records if r["record_type"] == "response")
    urls = {(r["record_id"].split(":")[2], r["url"]) for r in records}
    assert urls == {("3", "http://a/x%0D%0A%0D%0AWARC/1.1"), ("3", "http://a/x"), ("1", "%20http://b/%09%20"), ("5", "é"),
                    ("6", "z"), ("7", "")}


def test_a_payload_of_another_digest_is_not_complete(spark, tmp_path):
    (record,) = warc_archive._records("urn:page:1:a", "u", None, b"payload", 10_000)
    (tmp_path / "a.warc").write_bytes(record.replace(b"payload\r\n0", b"changed\r\n0") + b"\r\n\r\n")
    (found,) = warc_archive.read(spark, str(tmp_path)).collect()
    assert not found["is_complete"] and found["payload"] is None


def test_op7_against_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view pages as select * from '{SF_DIR}/pages.parquet'")
        result = db.sql(queries.ORACLE_SQL["op7_warc_archive"])
        columns, want = result.columns, sorted(result.fetchall())
    assert sorted(tuple(r) for r in queries.op7_warc_archive(spark, SF_DIR).select(*columns).collect()) == want


def test_missing_segments_are_told(spark, tmp_path):
    records = list(warc_archive._records("urn:page:1:a", "u", None, b"y" * 5000, 1000))
    records += list(warc_archive._records("urn:page:2:b", "u", None, b"z" * 5000, 1000))
    del records[2]  # a middle segment of the first page
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in reversed(records)))
    found = {r["record_id"]: r for r in warc_archive.read(spark, str(tmp_path)).collect()}
    assert not found["urn:page:1:a"]["is_complete"] and found["urn:page:1:a"]["payload"] is None
    assert found["urn:page:2:b"]["is_complete"] and bytes(found["urn:page:2:b"]["payload"]) == b"z" * 5000


def test_chunked_framing():
    for size in (0, 1, 4096, 10_000):
        data = random.Random(size).randbytes(size)
        assert warc_archive.unchunked(warc_archive.chunked(data, 4096)) == data
    assert warc_archive.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc_archive.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archive_of_a_table(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    first = {}
    for key in sorted(pages):
        first.setdefault(pages[key], key)
    for r in queries.op7_warc_archive(spark, SF_DIR).collect():
        data = pages.pop(r["page_id"])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        target = first[data] if first[data] != r["page_id"] else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(data), digest, target)
        assert r["record_type"] == ("revisit" if target is not None else "response")
    assert not pages
    empty = scratch_path(spark, "warc")
    warc_archive.write(spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(0), empty)
    assert warc_archive.pages(spark, empty).count() == 0
