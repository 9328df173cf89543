"""Operators 1, 5 and 6 against brute force, and their defined results for odd input."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinote.llm import components, iblt_fingerprint, jaccard_join, queries, template_decontamination, words

SF_DIR = "/root/testdata/sf0.001"


def shingle_set(text, n=5):
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(found[i:i + n]) for i in range(max(min(1, len(found)), len(found) - n + 1)))


def brute_join(rows, threshold=0.8):
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(sets, 0)
    copy = {k: min((o for o in sets if sets[o] == s), default=k) if s else k for k, s in sets.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, find(k), links[k], copy[k]) for k in sets)


def near_copies(seed, groups=12):
    """Groups of copies, near copies at many distances, short texts and texts without words."""
    draw, rows = random.Random(seed), []
    for _ in range(groups):
        base = draw.choices(["w%d" % i for i in range(3000)], k=draw.choice([30, 80, 200]))
        for _ in range(draw.choice([1, 2, 6, 40])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                text[draw.randrange(len(text))] = "e%d" % draw.randrange(50)
            rows.append(" ".join(text))
    rows += ["One two", "one TWO", "one two three four five", "one, two; three four five!", "", None, "!!! ??", "..."]
    draw.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, class_id int, rep string")


@pytest.mark.parametrize("chunk_rows", [512, 8])
def test_join_is_brute_force(spark, rows, monkeypatch, chunk_rows):
    """Also with buckets and neighbourhoods that lie in many chunks."""
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", chunk_rows)
    made = near_copies(chunk_rows)
    assert rows(jaccard_join.join(frame(spark, made)), "doc_id", "class_id", "n_links", "copy_id") == sorted(
        brute_join(made), key=repr
    )


def test_join_of_odd_rows(spark, rows):
    made = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    assert rows(jaccard_join.join(frame(spark, made))) == [(1, 1, 0, 1), (2, 2, 0, 2)]
    assert jaccard_join.join(frame(spark, [])).count() == 0
    kept = jaccard_join.keep_first(frame(spark, [*made, (3, "A b, c d e f")]))
    assert rows(kept, "doc_id") == [(1,), (1,), (2,), (None,)]
    assert kept.columns == ["doc_id", "text", "class_id", "rep"]


def test_posterior_bound():
    """A pair at the threshold is almost never dropped, a far one almost always."""
    for n in range(16, 97, 16):
        least = jaccard_join.fewest_matches(n, 0.8, 1e-6)
        assert 0 < least < 0.8 * n
    draw = np.random.default_rng(1)
    left = draw.integers(0, 1 << 16, (2000, 96)).astype(np.uint16)
    for similarity, low, high in ((0.8, 0.999, 1.0), (0.3, 0.0, 0.01)):
        same = draw.random((2000, 96)) < similarity
        right = np.where(same, left, left + 1)
        both = np.concatenate([left, right])
        kept, _ = jaccard_join.likely_pairs(both, np.arange(2000), np.arange(2000, 4000), 0.8, 1e-6)
        assert low <= len(kept) / 2000 <= high


def test_components(spark, rows):
    draw = random.Random(5)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert rows(found) == sorted([(n, r) for n, r in root.items() if sum(n in e and e[0] != e[1] for e in edges)], key=repr)


def test_shingles_of_many_texts():
    texts = ["a b c d e f", "", "!!", "A  b c,d e f", "x y", "f e d c b a"]
    hashes, counts = words.shingles(pa.array(texts))
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    assert counts.tolist() == [2, 0, 0, 2, 1, 2]
    assert (parts[0] == parts[3]).all() and not set(parts[0]) & set(parts[5])


# Fingerprints

def paragraphs(text):
    return {p.strip(" ") for p in re.findall(iblt_fingerprint._PARAGRAPH, text)} - {""}


def brute_versions(rows):
    ordered = sorted(rows, reverse=True)
    texts = [t or "" for _, t in ordered]
    out = []
    for (key, _), text, other in zip(ordered, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        near = []
        for version in (edited, other):
            a, b = paragraphs(text), paragraphs(version)
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near))
    return out


def same_versions(found, wanted):
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(wanted)
    for key, n, sha, near_edited, near_next in wanted:
        row = got[key]
        assert (row["n_chars"], row["edited_sha256"]) == (n, sha)
        assert row["near_edited"] == pytest.approx(near_edited) and row["near_next"] == pytest.approx(near_next)


def test_fingerprints_of_a_table(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op1_iblt_fingerprint(spark, SF_DIR)
    same_versions(found, brute_versions([tuple(r) for r in documents]))
    by_text = {}
    texts = {r["doc_id"]: r["text"] for r in documents}
    for row in found.select("doc_id", "fingerprint").collect():
        assert by_text.setdefault(texts[row["doc_id"]], row["fingerprint"]) == row["fingerprint"]


def test_fingerprints_of_odd_rows(spark):
    """Large differences, far keys, null and empty texts; a text past the largest table."""
    many = "\n".join(f"line {i}" for i in range(700))
    made = [(-9, None), (0, ""), (5, "é" * 9), (70, many), (10**15, many + "\nmore"), (10**15 + 1, "\n\n"), (3, "a\nb\nc")]
    df = spark.createDataFrame([*((k, t, "x") for k, t in made), (None, "lost", "x")], "doc_id long, text string, next string")
    same_versions(iblt_fingerprint.compare_versions(df), brute_versions(made))
    assert iblt_fingerprint.compare_versions(df.limit(0)).count() == 0
    alone = iblt_fingerprint.compare_versions(df.filter("doc_id = 3")).first()
    assert alone["near_next"] == 1.0


def test_every_text_meets_the_one_of_the_next_smaller_key(spark):
    """Dense, sparse and clustered keys up to the ends of their type."""
    rng = random.Random(5)
    keys = {-2**63, -2**63 + 1, 2**63 - 1, 2**62, -1, 0, 1, *range(10**6, 10**6 + 9000, 3), *range(2**40, 2**40 + 200)}
    keys |= {rng.getrandbits(64) - 2**63 for _ in range(3000)} | {rng.getrandbits(30) for _ in range(500)}
    ordered = sorted(keys, reverse=True)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    found = iblt_fingerprint.with_next(df, "doc_id", "text").select("doc_id", "text", "next", "bucket", "place").collect()
    assert {r["doc_id"]: r["next"] for r in found} == {k: f"t{n}" for k, n in zip(ordered, ordered[1:] + ordered[:1])}
    assert len(found) == len(keys) == len({(r["bucket"], r["place"]) for r in found})
    assert all(r["text"] == f"t{r['doc_id']}" for r in found)


def test_no_window_holds_all_sparse_keys(spark):
    """The last level of the chain has a thousand groups at most."""
    tops = spark.range(50_000).select(F.shiftright(F.xxhash64("id"), 6).alias("bucket"), F.xxhash64("id").alias("top"))
    groups = tops.select(F.shiftright("bucket", iblt_fingerprint._GROUP_BITS * iblt_fingerprint._LEVELS)).distinct()
    assert groups.count() <= 1024
    chained = {r["bucket"]: r["before"] for r in iblt_fingerprint._chained(tops).collect()}
    ordered = sorted((r["bucket"], r["top"]) for r in tops.collect())
    wanted = {b: t for (b, _), (_, t) in zip(ordered[1:] + ordered[:1], ordered)}
    assert chained == wanted


# Decontamination

ITEM = "Ann has 40 apples and gives 7 lb of them to Joe before Ann walks 9 km to the old market."
CASES = [
    (1, "Well. " + ITEM + " Then more text.", True),
    (2, "Tom has 12 apples and gives 5 kg of them to Mary before Tom walks 3 miles to the old market", True),
    (3, "Tom has 12 apples and gives 5 kg of them to Mary before Bob walks 3 miles to the old market", False),
    (4, "Ann has 40 apples and gives", False),
    (5, None, False),
    (6, "", False),
    (7, "12 40 Ann Joe 9 km " * 40, False),
]


@pytest.mark.parametrize("held", [template_decontamination.MAX_HELD_HASHES, 0])
def test_templates(spark, rows, held):
    """The same whether tasks hold the benchmark's hashes or all windows are joined."""
    documents = spark.createDataFrame([(k, t, "x") for k, t, _ in CASES] + [(None, ITEM, "x"), (1, CASES[0][1], "y")],
                                      "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "only five words in here"), (9, None), (None, ITEM), (10, "")],
                                  "item_id long, text string")
    found = template_decontamination.find(documents, items, max_held_hashes=held)
    assert rows(found, "doc_id", "item_id") == [(k, 7) for k, _, hit in CASES if hit]
    assert {r["doc_id"]: r["same_values"] for r in found.collect()} == {1: True, 2: False}
    kept = template_decontamination.drop_contaminated(documents, items, max_held_hashes=held)
    assert rows(kept, "doc_id") == sorted([(k,) for k, _, hit in CASES if not hit] + [(None,)], key=repr)
    assert template_decontamination.find(documents.limit(0), items).count() == 0
    assert template_decontamination.find(documents, items.limit(0)).count() == 0


EDITED = [
    (1, ITEM.replace("gives 7", "then gives 7"), True),
    (2, ITEM.replace("of them", "them"), True),
    (4, ITEM.replace("Ann", "Mary Lou").replace("Joe", "Old Mr Smith"), True),
    (5, "Mary " + ITEM.replace("40", "1,2,3").replace("7", "10,20,30").replace("lb", "kg").replace("Joe", "Jim Doe"), True),
    (6, ITEM.replace("before Ann", "before Bob"), False),
    (7, " ".join(ITEM.split()[8:] + ITEM.split()[:8]), True),
    (8, "Ann has 40 apples and gives " + "word " * 60 + "walks 9 km to the old market", False),
    (9, " ".join(ITEM.replace("40", str(k)).replace("Ann", name) for k, name in enumerate(["Jo", "Al", "Cy"])), True),
]


def test_edited_items_are_found(spark, rows):
    """Inserted, removed and changed words, longer names and numbers; contradictions and far parts are none."""
    documents = spark.createDataFrame([(k, f"so it goes {t} and on") for k, t, _ in EDITED], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    for held in (template_decontamination.MAX_HELD_HASHES, 0):
        found = template_decontamination.find(documents, items, max_held_hashes=held)
        assert rows(found, "doc_id") == [(k,) for k, _, hit in EDITED if hit]


def test_items_of_placeholders_are_found_with_their_values(spark, rows):
    of_slots = ["What is 345 + 678 + 12 - 7?", "Paris London Rome Berlin Madrid", "1 2 3 4 5 6 7 8 9 10 11 12", "The Old Man And The Sea"]
    documents = [(k, f"Yes {t} Good 5 more") for k, t in enumerate(of_slots)]
    documents += [(4, "What is 34 + 67 + 1 - 8? Oslo Wien Bern Kiev Riga. 9 8 7 6 5 4 3 2 1 0 1 2 3 4 The New Car"), (5, ITEM.replace("them", "those"))]
    frame = spark.createDataFrame(documents, "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(of_slots), (5, ITEM)], "item_id long, text string")
    for held in (template_decontamination.MAX_HELD_HASHES, 0):
        found = template_decontamination.find(frame, items, max_held_hashes=held)
        assert rows(found, "doc_id", "item_id", "same_values") == [(k, k, True) for k in (0, 1, 2, 3, 5)]


def test_a_word_more_or_less_in_every_item(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    edited = []
    for k, text in items:
        words_of = text.split()
        middle = len(words_of) // 2
        edited += [(k, " ".join(words_of[:middle] + more + words_of[rest:])) for more, rest in (
            (["zzz"], middle), ([], middle + 1), (["zzz"], middle + 1))]
    documents = spark.createDataFrame([(3 * k + n % 3, t) for n, (k, t) in enumerate(edited)], "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in template_decontamination.find(documents, frame).collect()}
    assert found == {(3 * k + n, k) for k, _ in items for n in range(3)}


def test_short_items_are_found_whole(spark, rows):
    documents = spark.createDataFrame([(1, "see only five words in here now"), (2, "only five words")], "doc_id long, text string")
    items = spark.createDataFrame([(8, "only five words in here")], "item_id long, text string")
    assert rows(template_decontamination.find(documents, items), "doc_id") == [(1,)]


def test_every_planted_item_is_found(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    wanted = {(d["doc_id"], i["item_id"]) for d in documents for i in items if i["text"] in (d["text"] or "")}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op6_template_decontamination(spark, SF_DIR).collect()}
    assert found == wanted


def test_join_of_a_table(spark, rows):
    documents = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op5_jaccard_join(spark, SF_DIR)) == sorted(brute_join(documents), key=repr)


def test_a_repeated_key_with_two_texts_has_one_result(spark):
    draw = random.Random(21)
    words = [f"w{draw.randrange(400)}" for _ in range(300)]
    near = " ".join(words[:290] + ["other"] * 3)
    rows = [(2, " ".join(words)), (2, " ".join(f"q{k}" for k in range(200))), (3, near), (3, near), (4, " ".join(words)),
            (5, None), (5, "short text"), (5, " ".join(words))]
    results = [
        sorted(tuple(r) for r in jaccard_join.join(
            spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(n)).collect())
        for n in (1, 3, 4, 7) for k in (0, 3)
    ]
    assert all(r == results[0] for r in results) and len(results[0]) == 4


def test_items_in_unspaced_scripts_and_without_words(spark):
    items = spark.createDataFrame(
        [(1, "你好世界今天天气怎么样"), (2, "??? !!!"), (3, "→ → ←"), (4, "สวัสดีชาวโลกวันนี้"), (5, " "), (6, "何時ですか 今日は")],
        "item_id long, text string")
    texts = [
        (1, "昨天他说你好世界今天天气怎么样我说好"), (2, "really??? !!! yes"), (3, "really ?? !!! yes"), (4, "a→→←←b"), (5, "→→ b ←"),
        (6, "ก่อนสวัสดีชาวโลกวันนี้หลัง"), (7, "plain words only here"), (8, "你好 世界 昨天"), (9, "(????!!!!)"), (None, "??? !!!"), (10, None),
        (11, "それは何時ですか 今日はいい"), (2, "really??? !!! yes"),
    ]
    documents = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, symbols string")
    for held in (template_decontamination.MAX_HELD_HASHES, 0):
        found = template_decontamination.find(documents, items, max_held_hashes=held).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 2), (4, 3), (6, 4), (9, 2), (11, 6)]
    assert template_decontamination.drop_contaminated(documents, items).count() == 6


def brute_verbatim(text, item):
    """An item stands in a text word by word."""
    words = lambda t: re.findall(r"[^\W_]+", re.sub(r"(\d)[.,](\d)", r"\1\2", t).lower())
    a, b = words(text), words(item)
    return bool(b) and any(a[k:k + len(b)] == b for k in range(len(a) - len(b) + 1))


def test_every_verbatim_copy_is_found_and_nothing_in_other_words(spark):
    draw = random.Random(31)
    vocabulary = ["the", "cost", "of", "Tom", "Ann", "12", "3", "km", "apples", "is", "how", "many", "left", "when", "Paris", "x9"]
    make = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, make(draw.choice([1, 3, 7, 8, 12, 30]))) for k in range(40)]
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    texts = []
    for k in range(150):
        other = [draw.choice(filler) for _ in range(draw.randrange(30))]
        at = draw.randrange(len(other) + 1)
        item = draw.choice(items)[1] if k % 3 else ""
        texts.append((k, " ".join([*other[:at], item, *other[at:]])))
    found = {(r["doc_id"], r["item_id"]) for r in template_decontamination.find(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    verbatim = {(k, i) for k, t in texts for i, item in items if brute_verbatim(t, item)}
    assert verbatim <= found
    assert not {k for k, _ in found} & {k for k, t in texts if k % 3 == 0}
