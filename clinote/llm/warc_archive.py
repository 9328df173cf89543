"""WARC writing with segmented records and chunked payloads, and their reassembly (operator 7).

Every record is one row of a text table whose line separator is the empty line that ends a
WARC record, so Spark's own writer makes valid archives on any file system. Responses carry
their payload in chunked transfer framing; a long record is split into segments, which may
lie in different files. Reading groups continuation records by the identifier of their
origin, orders them by segment number, verifies the total length, and takes the framing off.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinote.llm.workers import map_batches
from clinote.session import store

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2_000
_END = b"\r\n\r\n"
#: Records carry no clock time, so that a rerun writes the same bytes.
_DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[a:a + size] for a in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%s\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload behind chunked framing; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = line + 2
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _records(record_id: str, url: str, refers_to: str | None, payload: bytes, segment_bytes: int) -> Iterator[bytes]:
    """The record of a page without the empty line at its end: one, or a first segment and its continuations."""
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<{refers_to}>"),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(payload)
    content = ("Content-Type", "application/http;msgtype=response")
    parts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *common, content], block)
        return
    for number, part in enumerate(parts, start=1):
        if number == 1:
            fields = [("WARC-Type", "response"), *common, content, ("WARC-Segment-Number", "1")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{number}>"), ("WARC-Date", _DATE),
                      ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(number))]
        if number == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, part)


def _one_line(url: Column) -> Column:
    """The URL as a header value: what would end its line or be trimmed off is a percent code."""
    marks = F.split(url, "")
    coded = F.transform(marks, lambda c: F.when(
        c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]|^ | $"), F.array_join(coded, "")).otherwise(url)


def write(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
    min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write a record per page to ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the
    smallest key is a response and the others are revisits of it. A null payload is empty
    and a null URL is written as ``-``; control characters in a URL, and blanks at its ends, are written as
    percent codes. Rows without a key are left out; rows that share key
    and payload are one record, with the smallest URL. Equal payloads and repeated rows are found on digests, combined
    before the shuffle; payloads are shuffled for repeated rows alone.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.coalesce(_one_line(F.col(url)), F.lit("-")).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).filter(F.col("key").isNotNull())
    hashed = rows.groupBy("key", F.sha1("payload").alias("sha1"), F.length("payload").alias("bytes")).agg(
        F.count("*").alias("copies")
    )
    firsts = hashed.groupBy("sha1").agg(F.min("key").alias("first"))
    is_revisit = (F.col("bytes") >= min_revisit_bytes) & (F.col("key") != F.col("first"))
    # Stored, so that the planner knows its size and moves the payloads only where revisits are many.
    noted = hashed.join(firsts, "sha1").filter(is_revisit | (F.col("copies") > 1)).select(
        "key", "sha1", F.when(is_revisit, F.col("first")).alias("first"), "copies"
    )
    noted = store(pages.sparkSession, noted, "revisits")
    marked = rows.withColumn("sha1", F.sha1("payload")).join(noted, ["key", "sha1"], "left")
    if not noted.filter("copies > 1").isEmpty():
        repeated = marked.filter("copies > 1").groupBy("key", "sha1").agg(
            F.min("url").alias("url"), F.any_value("payload").alias("payload"), F.any_value("first").alias("first")
        )
        columns = ["key", "url", "sha1", "first", "payload"]
        marked = marked.filter("copies is null or copies = 1").select(*columns).unionByName(repeated.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for number, address, sha1, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                refers_to = None if first is None else f"urn:page:{first}:{sha1}"
                for record in _records(f"urn:page:{number}:{sha1}", address, refers_to, data, segment_bytes):
                    held.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    made = map_batches(marked.select("key", "url", "sha1", "first", "payload"), run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END.decode()).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(_END, at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        first = end + len(_END)
        last = first + int(fields["content-length"])
        yield fields, archive[first:last]
        at = last + len(_END)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(_END)
    framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return unchunked(body) if framed else body


_PARSED = (
    "record_id string, record_type string, url string, refers_to string, stated_digest string, "
    "segment int, total_length long, block binary"
)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PARSED.split(", ")]
    types = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    bare = lambda value: value.strip("<>") if value else None
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for fields, block in parse(content):
                segment, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                rows.append((
                    bare(fields.get("warc-segment-origin-id") or fields["warc-record-id"]), fields["warc-type"],
                    fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")),
                    (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                    int(segment) if segment else None, int(total) if total else None, block,
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types],
                names=names,
            )


def read(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, segments put together.

    Columns: ``record_id, record_type`` (response or revisit), ``url, refers_to,
    stated_digest, is_complete, payload_bytes, payload_digest`` and, if kept, ``payload``. A
    record of which a segment is missing, given twice with other content or of the wrong
    total length, whose framing is cut short, or whose payload has another digest than stated, is not complete
    and has no payload. The
    payload columns of a revisit are null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = map_batches(files, _parse_files, _PARSED)
    whole = parsed.filter("segment is null").withColumn("is_whole", F.lit(True)).drop("segment", "total_length")
    parts = F.sort_array(F.collect_set(F.struct("segment", "block")))
    first = lambda name: F.max(F.when(F.col("segment") == 1, F.col(name))).alias(name)
    gathered = parsed.filter("segment is not null").groupBy("record_id").agg(
        first("record_type"), first("url"), first("refers_to"), first("stated_digest"),
        F.max("total_length").alias("total"), parts.alias("parts"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda held, part: F.concat(held, part["block"]))
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = gathered.withColumn("block", block).select(
        "record_id", "record_type", "url", "refers_to", "stated_digest", "block",
        F.coalesce(gapless & (F.length("block") == F.col("total")), F.lit(False)).alias("is_whole"),
    )
    schema = (
        "record_id string, record_type string, url string, refers_to string, stated_digest string, "
        "is_complete boolean, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            wanted = ("record_type", "block", "is_whole", "stated_digest")
            for kind, data, is_whole, stated in zip(*(batch.column(n).to_pylist() for n in wanted)):
                payload = digest = None
                if is_whole and kind == "response":
                    try:
                        payload = _payload(data)
                        digest = payload_digest(payload)
                    except ValueError:
                        is_whole = False
                    if digest is not None and stated is not None and digest != stated:
                        payload, digest, is_whole = None, None, False
                made.append((is_whole, payload, digest))
            payloads = [p for _, p, _ in made]
            columns = [
                *(batch.column(n) for n in ("record_id", "record_type", "url", "refers_to", "stated_digest")),
                pa.array([w for w, _, _ in made], pa.bool_()),
                pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                pa.array([d for _, _, d in made], pa.string()),
                *([pa.array(payloads, pa.binary())] if keep_payload else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return map_batches(joined.unionByName(whole), run, schema)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of archives written by ``write``.

    The figures of a revisit are those of the payload it refers to. A record that is not complete gives
    nulls for both.
    """
    records = read(spark, path, keep_payload=False).withColumns({
        name: F.split_part(column, F.lit(":"), F.lit(3)).cast("long")
        for name, column in (("page_id", F.col("record_id")), ("refers_page", F.col("refers_to")))
    })
    responses = records.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    targets = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("target"), "payload_bytes", "payload_digest"
    )
    revisits = (
        records.filter("record_type = 'revisit'")
        .select("page_id", "record_type", F.col("refers_to").alias("target"), F.col("refers_page").alias("refers_to"))
        .join(targets, "target", "left")
    )
    return responses.unionByName(revisits.drop("target"))


def sql(min_revisit_bytes: int = 0) -> str:
    """The rows of ``pages`` after ``write`` over a table ``pages`` with unique keys, as SQL."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hex digits are four characters of base32.
    quarter = ", ".join(f"substr('{alphabet}', (v >> {shift}) % 32 + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
    with payload as (select page_id, encode(coalesce(html, '')) as body from pages where page_id is not null),
    digest as (select page_id, octet_length(body) as n, sha1(body) as hex from payload),
    bits as (select *, list_transform(range(8), lambda k: cast('0x' || substr(hex, 5 * k + 1, 5) as int)) as held from digest),
    named as (
        select page_id, n, array_to_string(list_transform(held, lambda v: concat({quarter})), '') as payload_digest,
               min(page_id) over (partition by hex) as first
        from bits
    )
    select page_id, n as payload_bytes, payload_digest,
           case when n >= {min_revisit_bytes} and first <> page_id then 'revisit' else 'response' end as record_type,
           case when n >= {min_revisit_bytes} and first <> page_id then first end as refers_to
    from named"""
