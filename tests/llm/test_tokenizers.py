"""Operators 3, 4 and 8 against the libraries, and their defined results for odd input."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clinote.llm import bpe_automaton, queries, token_archive, token_counts
from clinote.session import scratch_path

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SF_DIR = "/root/testdata/sf0.001"
os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = [
    "", "   ", "a  b", " a", "a ", "\n \nb", "don't we'll I'M", "<|endoftext|>x <|endoftext|>  y", "aaaaaaaaaaa",
    "\x1c\x1d a\x1cb", " a  b", "日本語 ñandú", "éx ́", "🙂🙂 a🙂", "\t\tx\r\n\r\n y", "ab" * 300, "x" * 3000,
    "<s>x</s> <unk> <0x0A>", "x▁y ▁▁ z", "ΑΣ Σ", "<|startoftext|", "a\x00b", "  b", "İ ǅ",
]
TEXTS = st.text(st.sampled_from("ab c\n.1'sS é\tth er<|"), max_size=60)


@pytest.fixture(scope="module")
def byte_encoder():
    return bpe_automaton.encoder(BYTE)


def split(flat, counts):
    return [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])]


@settings(max_examples=30, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_automaton_is_the_library(byte_encoder, texts):
    theirs = Tokenizer.from_file(BYTE)
    for batch in (texts, ODD):
        ours = split(*byte_encoder.encode(pa.array(batch)))
        wanted = [e.ids for e in theirs.encode_batch(batch, add_special_tokens=False)]
        assert ours == wanted
        assert [byte_encoder.automaton.decode(ids) for ids in ours] == [
            theirs.decode(ids, skip_special_tokens=False) for ids in wanted
        ]


def test_arcs_are_what_the_merges_leave_unchanged():
    """On a small vocabulary: two tokens have an arc exactly if encoding their text gives them back."""
    labels = [b"a", b"b", b"ab", b"aa", b"aab", b"bb", b"aaab"]
    merges = [(0, 1, 2), (0, 0, 3), (0, 2, 4), (1, 1, 5), (3, 2, 6)]
    automaton = bpe_automaton.MergeAutomaton(labels, merges, {})

    def merged(text):
        parts = [labels.index(bytes([c])) for c in text]
        for left, right, made in merges:
            at = 0
            while at < len(parts) - 1:
                if (parts[at], parts[at + 1]) == (left, right):
                    parts[at:at + 2] = [made]
                at += 1
        return parts

    for s in range(len(labels)):
        for t in range(len(labels)):
            stable = merged(labels[s] + labels[t]) == [s, t]
            assert automaton.has_arc(np.array([s]), np.array([t]))[0] == stable, (labels[s], labels[t])
    words = ["".join(random.Random(n).choices("ab", k=n % 12 + 1)).encode() for n in range(300)]
    flat, counts = automaton.encode_words(words)
    assert split(flat, counts) == [merged(w) for w in words]


def test_decoding_bytes_that_are_no_text(byte_encoder):
    theirs = Tokenizer.from_file(BYTE)
    for ids in ([128], [162, 10], [447], [50256, 447, 247]):
        assert byte_encoder.automaton.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@settings(max_examples=30, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_counts_are_the_library(texts):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter = token_counts.counter(PIECE)
    for batch in (texts, ODD):
        assert counter.count(pa.array(batch)).tolist() == [len(ids) for ids in theirs.encode(batch, num_threads=1)]


def test_long_pre_tokens_merge_in_few_rounds():
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["=-=-" * 5000, "thethe" * 3000, "abc" * 4000, "a" * 20000]
    assert token_counts.counter(PIECE).count(pa.array(texts)).tolist() == [len(x) for x in theirs.encode(texts)]


@settings(max_examples=20, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_library_encoder_is_the_library(texts):
    theirs = Tokenizer.from_file(WORD)
    for batch in (texts, ODD):
        ours = split(*token_archive.encoder(WORD).encode(pa.array(batch)))
        assert ours == [e.ids for e in theirs.encode_batch(batch, add_special_tokens=False)]


def test_closing_marks_are_parted_only_where_the_library_parts_them():
    """Behind marks that combine, letters that fall apart, other symbols and special strings they stay."""
    draw = random.Random(5)
    bits = [
        "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ".", ",", "%", "&&", "*", "#", "'", "'s", "'S", "=", "…", "_", " ",
        "\n", "\xa0", "\x00", "a", "B", "9", "²", "½", "ß", "é", "e\u0301", "\u0301", "\u0338", "İ", "\u0958", "\u0915",
        "Я", "Й", "ΑΣ", "ǅ", "ŉ", "\u2126", "\u212a", "中文", "가", "\u0345", "😀", "\u200b", "don't", "endoftext",
    ]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(20_000)]
    library = Tokenizer.from_file(WORD)
    ours = split(*token_archive.LibraryEncoder(WORD).encode(pa.array(texts)))
    assert ours == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_remembered_once():
    """Not a second time with the marks behind it: a worker's memory is mostly the words it has met."""
    import tracemalloc

    texts = pa.array([" ".join(f"w{n}." for n in range(first, first + 1000)) for first in range(0, 100_000, 1000)])
    coder = token_archive.LibraryEncoder(WORD)
    tracemalloc.start()
    coder.encode(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 22_000_000


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=200))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), dtype=np.int64)
    hashed = token_archive.PerfectHash.from_bytes(token_archive.PerfectHash.build(keys).to_bytes())
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))


def frame(spark, rows):
    """Keys and texts among columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, n_tokens int"
    )


ROWS = [(2, "two words"), (1, None), (None, "no key"), (3, ""), (2, "two words"), (4, "x" * 70_000)]


def test_encode_decode_frames(spark, rows):
    df = frame(spark, ROWS)
    encoded = bpe_automaton.encode(df, BYTE)
    assert encoded.columns == ["doc_id", "ids"]
    assert rows(bpe_automaton.decode(encoded, BYTE)) == sorted([(k, t or "") for k, t in ROWS], key=repr)
    checked = bpe_automaton.encode_checked(df, BYTE)
    assert checked.filter("is_lossless").count() == len(ROWS)
    empty = frame(spark, [])
    assert bpe_automaton.encode(empty, BYTE).count() == bpe_automaton.round_trip(empty, BYTE).count() == 0


def test_count_frame(spark, rows):
    found = token_counts.count_tokens(frame(spark, ROWS), PIECE, limit=2)
    by_key = {r["doc_id"]: tuple(r) for r in found.collect()}
    assert found.count() == len(ROWS)
    assert by_key[1] == (1, 0, 0, False) and by_key[3] == (3, 0, 0, False)
    assert by_key[4][1] == 70_000 and by_key[4][3]
    assert token_counts.count_tokens(frame(spark, []), PIECE).count() == 0


def test_archive(spark):
    """Nulls, repeated keys, lost keys, and keys that the archive does not hold."""
    path = scratch_path(spark, "archive")
    token_archive.write(frame(spark, [*ROWS, (2, "smaller?"), (-5, "minus")]), path, WORD, bucket_keys=2)
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, -5, 99, None, 2)], "doc_id long")
    found = {r["doc_id"]: r for r in token_archive.digests(keys, path).collect()}
    assert set(found) == {1, 2, 3, 4, -5}
    theirs, start = Tokenizer.from_file(WORD), 0
    for key, text in [(-5, "minus"), (1, ""), (2, "smaller?"), (3, ""), (4, "x" * 70_000)]:
        ids = theirs.encode(text, add_special_tokens=False).ids + [1]
        row = found[key]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    raw = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_archive.fetch(keys, path).collect()}
    assert raw[2] == theirs.encode("smaller?", add_special_tokens=False).ids + [1]


def test_empty_archive(spark):
    path = scratch_path(spark, "archive")
    token_archive.write(frame(spark, []), path, WORD)
    assert token_archive.digests(frame(spark, ROWS).select("doc_id"), path).count() == 0


def test_queries(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    theirs = Tokenizer.from_file(BYTE)
    for row in queries.op3_bpe_automaton(spark, SF_DIR).collect():
        ids = theirs.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (row["n_tokens"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for row in queries.op4_token_counts(spark, SF_DIR).collect():
        n = len(pieces.encode(texts[row["doc_id"]]))
        assert tuple(row)[1:] == (len(texts[row["doc_id"]].encode()), n, n > 4096)
    words, start = Tokenizer.from_file(WORD), 0
    for row in sorted(queries.op8_token_archive(spark, SF_DIR).collect(), key=lambda r: r["doc_id"]):
        ids = words.encode(texts[row["doc_id"]], add_special_tokens=False).ids + [1]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
