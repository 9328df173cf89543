"""Document fingerprints as invertible Bloom lookup tables (operator 1).

A text is the set of its paragraphs. The digest of a paragraph is added to three cells of
a table; a cell holds a count, the XOR of its digests and the XOR of their check sums. Tables
of two versions subtract cell by cell, which leaves the paragraphs that differ; a cell with
one digest gives it away, and taking that out of its other cells peels the rest. Where
peeling gets stuck, a larger table is tried: one of as many blocks as the two texts have
paragraphs for. A block that gets stuck again is tried with 4 and 32 times its cells, and the
digests of a block that even these do not part are compared.

Blocks are independent and hold 24 cells for some eight paragraphs, so the cost grows with the
number of paragraphs and not with its square. Everything is a column expression, a group or a
window; what is done for a text stays in the partition that got its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinote.functions.columns import compute_once

CELLS, PART = 24, 8  # a block has three parts, and a digest a cell in each
#: Blocks of the tables that are tried in turn for a set of digests; the first is the fingerprint.
BLOCKS = (1, 4, 32)
#: Digests of both texts for which a larger table has one block.
BLOCK_DIGESTS = 8
ROUNDS = 6
_CHECK, _PLACE = "iblt-check", "iblt-place"
#: A line is a paragraph; in a long one, sentences are joined to paragraphs of at least so many characters.
PARAGRAPH_CHARS = 160
_PARAGRAPH = rf"[^\n]{{{PARAGRAPH_CHARS}}}[^\n]*?[.!?](?=\s)|[^\n]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text; none for null, empty and blank text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARAGRAPH), F.lit(0))
    trimmed = F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(trimmed, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(_CHECK))


def _entries(digest_array: Column) -> Column:
    """Per digest: its check sum, its three cells in a block, and the number that decides the block."""
    def entry(d: Column, g: Column) -> Column:
        return F.struct(d.alias("d"), _check(d).alias("h"), _cells(g).alias("m"), F.shiftright(g, 9).alias("b"))

    return F.transform(digest_array, lambda d: _let(F.xxhash64(d, F.lit(_PLACE)), lambda g: entry(d, g)))


#: Each cell of a block has a bit; these are the bits of a part, one row for each of the three.
_BITS = [[1 << (PART * part + i) for i in range(PART)] for part in range(CELLS // PART)]


def _cells(g: Column) -> Column:
    """The bits of the three cells that a place number decides on, one in each part."""
    bits = [
        F.element_at(F.lit(part), (F.shiftright(g, 3 * i).bitwiseAND(F.lit(PART - 1)) + F.lit(1)).cast("int"))
        for i, part in enumerate(_BITS)
    ]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _in_cell(entry: Column, bit: Column) -> Column:
    return entry["m"].bitwiseAND(bit) != 0


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


def table(digest_array: Column, blocks: int) -> Column:
    """The cells of each block: ``array<array<struct<n, k, h>>>``."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def block(held: Column) -> Column:
        return F.transform(F.lit(sum(_BITS, [])), lambda bit: F.aggregate(
            held, zero,
            lambda c, e: F.when(
                _in_cell(e, bit), _cell(c["n"] + 1, c["k"].bitwiseXOR(e["d"]), c["h"].bitwiseXOR(e["h"]))
            ).otherwise(c),
        ))

    entries = _entries(digest_array)
    if blocks == 1:
        return F.array(_let(entries, block))
    of_block = _let(entries, lambda all_: F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda b: F.filter(all_, lambda e: e["b"].bitwiseAND(F.lit(blocks - 1)) == b),
    ))
    return F.transform(of_block, block)


def subtract(one: Column, other: Column) -> Column:
    """Cell by cell: the table of what only one side has (counted 1) and only the other (-1)."""
    return F.zip_with(one, other, lambda a, b: F.zip_with(a, b, lambda x, y: _cell(
        x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])
    )))


def _peel_block(cells: Column) -> Column:
    """``array<struct<d, n>>`` of the digests in a block, or null where peeling gets stuck.

    Only cells that hold something are kept from round to round.
    """
    def placed(c: Column, i: Column) -> Column:
        return F.struct(
            F.element_at(F.lit(sum(_BITS, [])), i + 1).alias("m"), c["n"].alias("n"), c["k"].alias("k"), c["h"].alias("h"),
        )

    def holds(c: Column) -> Column:
        return (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)

    def is_pure(c: Column) -> Column:
        return ((c["n"] == 1) | (c["n"] == -1)) & (c["h"] == _check(c["k"]))

    def found(state: Column) -> Column:
        pure = F.filter(state["cells"], is_pure)
        return F.array_distinct(F.transform(pure, lambda c: _let(
            F.xxhash64(c["k"], F.lit(_PLACE)),
            lambda g: F.struct(c["k"].alias("d"), c["h"].alias("h"), c["n"].alias("n"), _cells(g).alias("m")),
        )))

    def without(state: Column, keys: Column) -> Column:
        left = F.transform(state["cells"], lambda c: F.aggregate(
            keys, c,
            lambda held, e: F.when(_in_cell(e, held["m"]), F.struct(
                held["m"].alias("m"), (held["n"] - e["n"]).alias("n"),
                held["k"].bitwiseXOR(e["d"]).alias("k"), held["h"].bitwiseXOR(e["h"]).alias("h"),
            )).otherwise(held),
        ))
        known = F.transform(keys, lambda e: F.struct(e["d"].alias("d"), e["n"].alias("n")))
        return F.struct(F.filter(left, holds).alias("cells"), F.concat(state["known"], known).alias("known"))

    start = F.struct(
        F.filter(F.transform(cells, placed), holds).alias("cells"),
        F.array().cast("array<struct<d:bigint,n:int>>").alias("known"),
    )
    step = lambda state, _: F.when(F.size(state["cells"]) == 0, state).otherwise(_let(
        found(state), lambda keys: F.when(F.size(keys) == 0, state).otherwise(without(state, keys))
    ))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.size(s["cells"]) == 0, s["known"])
    )


def peel(difference: Column) -> Column:
    """``array<struct<d, n>>``: the digests that differ, with 1 or -1 for the side; null where it gets stuck."""
    return _let(
        F.transform(difference, _peel_block),
        lambda peeled: F.when(F.forall(peeled, lambda p: p.isNotNull()), F.flatten(peeled)),
    )


def differing(one: Column, other: Column, one_table: Column, other_table: Column) -> Column:
    """The digests that differ, from the tables (of ``BLOCKS[0]``) and, where these are too small, from larger ones."""
    tries = [peel(subtract(one_table, other_table))]
    tries += [peel(subtract(table(one, blocks), table(other, blocks))) for blocks in BLOCKS[1:]]
    only = lambda a, b, n: F.transform(
        F.array_except(a, b), lambda d: F.struct(d.alias("d"), F.lit(n).alias("n"))
    )
    return F.coalesce(*tries, F.concat(only(one, other, 1), only(other, one, -1)))


def likeness(n_one: Column, n_other: Column, n_differing: Column) -> Column:
    """Shared paragraphs over all paragraphs; 1 for two texts without any."""
    total = n_one + n_other
    return F.when(total == 0, 1.0).otherwise((total - n_differing) / (total + n_differing))


def as_text(cells: Column) -> Column:
    """A fingerprint as text: count, digest and check sum of each cell in hexadecimal."""
    def part(c: Column) -> Column:
        return F.concat(F.lower(F.hex(c["n"])), F.lit("."), F.lower(F.hex(c["k"])), F.lit("."), F.lower(F.hex(c["h"])))

    return F.array_join(F.transform(F.flatten(cells), part), ",")


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digests, cells``: the paragraph digests of every text and its table of ``BLOCKS[0]`` blocks."""
    made = compute_once(df.select(F.col(key), F.col(text).alias("text")), {"digests": digests(F.col("text"))})
    return made.select(key, "digests", table(F.col("digests"), BLOCKS[0]).alias("cells"))


#: Keys of a bucket share all but their last bits; a level's groups share all but some more of them, up to the top,
#: which has at most a thousand.
_BUCKET_BITS, _GROUP_BITS, _LEVELS = 6, 12, 4


def _chained(tops: DataFrame) -> DataFrame:
    """``bucket, before``: the largest key before each bucket; before the first one, the largest of all.

    ``tops`` has the largest key of each ``bucket``. A bucket asks its predecessor in its group, and the first of a group
    the predecessor of the group, level by level. So a window holds at most 2^12 rows, however the keys lie.
    """
    levels = [tops.select(F.col("bucket").alias("id"), "top")]
    for _ in range(_LEVELS):
        levels.append(levels[-1].groupBy(F.shiftright("id", _GROUP_BITS).alias("id")).agg(F.max("top").alias("top")))
    before = levels[-1].select("id", F.coalesce(
        F.lag("top").over(Window.orderBy("id")), F.max("top").over(Window.partitionBy())
    ).alias("before"))
    for level in reversed(levels[:-1]):
        inside = F.lag("top").over(Window.partitionBy("group").orderBy("id"))
        placed = level.withColumn("group", F.shiftright("id", _GROUP_BITS)).withColumn("inside", inside)
        outside = before.select(F.col("id").alias("group"), F.col("before").alias("outside"))
        before = placed.join(outside, "group").select("id", F.coalesce("inside", "outside").alias("before"))
    return before.withColumnRenamed("id", "bucket")


def with_next(df: DataFrame, key: str, column: str, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, column, next, bucket, place``: ``next`` is the column of the row with the next smaller key; after the
    smallest, the largest's. ``bucket, place`` names a row, and rows are partitioned by ``bucket``.

    What ``made`` adds to a frame with ``value``, the column, comes along, as its own column
    and as ``next_`` for the next row.

    Keys are integers. Rows are ordered within buckets of neighbouring keys. A bucket also gets the row that
    precedes it, found by chaining the buckets' largest keys; where keys are sparse, that is a row for each.
    """
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("value")).filter(F.col("key").isNotNull())
    rows = rows.withColumn("bucket", F.shiftright("key", _BUCKET_BITS))
    tops = rows.groupBy("bucket").agg(F.max("key").alias("top"))
    guests = _chained(tops).select(F.col("bucket").alias("to"), F.col("before").alias("top"))
    guests = guests.withColumn("from", F.shiftright("top", _BUCKET_BITS))
    # Text is shuffled once, for both branches; of it, only the largest key of each bucket goes on to the next.
    # (Stated for both, as the join would add it to its own branch and keep the shuffle from being shared.)
    dealt = rows.filter(F.col("bucket").isNotNull()).repartition("bucket")
    # The guest is the largest key of its bucket, so ">=" finds it and the join stays on the bucket alone.
    # Equal keys are ordered by content; of those, the last is the one that precedes another bucket.
    visiting = (
        dealt.join(guests, (F.col("bucket") == F.col("from")) & (F.col("key") >= F.col("top"))).groupBy("to")
        .agg(F.max_by("value", F.xxhash64("value")).alias("value"))
    )
    ready = made(dealt) if made else dealt
    guest = made(visiting) if made else visiting
    added = [c for c in ready.columns if c not in dealt.columns]
    ordered = Window.partitionBy("bucket").orderBy("key", F.xxhash64("value"))
    inside = ready.select(
        "*", F.row_number().over(ordered).alias("place"),
        *[F.lag(c).over(ordered).alias(f"next_{c}") for c in ["value", *added]],
    )
    met = inside.join(guest.select("to", *[F.col(c).alias(f"guest_{c}") for c in ["value", *added]]),
                      F.col("bucket") == F.col("to"), "left")
    following = {
        c: F.when(F.col("place") == 1, F.col(f"guest_{c}")).otherwise(F.col(f"next_{c}")) for c in ["value", *added]
    }
    return met.select(
        F.col("key").alias(key), F.col("value").alias(column), following["value"].alias("next"), "bucket", "place",
        *added, *[following[c].alias(f"next_{c}") for c in added],
    )


def _larger_tables(tried: DataFrame, row: list[str], gaps: dict[str, str], kept: list[str]) -> DataFrame:
    """``row, kept`` and the number of differing digests of each comparison, by larger tables where that is null.

    ``gaps`` names the number of a comparison and the digests that ``own`` is compared with.
    Digests are dealt to blocks, each with its cells; the rest of a row travels in one element.
    """
    main = F.struct(*[F.col(c) for c in [*kept, *gaps]])
    element = "struct<what:int,block:bigint,d:bigint,sign:int>"

    def signed(what: int, number: str, other: str) -> Column:
        blocks = F.ceil((F.size("own") + F.size(other)) / BLOCK_DIGESTS).cast("long")
        one = lambda sign: lambda d: F.struct(
            F.lit(what).alias("what"), F.pmod(F.xxhash64(d, F.lit("iblt-block")), blocks).alias("block"),
            d.alias("d"), F.lit(sign).alias("sign"),
        )
        both = F.concat(F.transform("own", one(1)), F.transform(other, one(-1)))
        return F.when(F.col(number).isNull(), both).otherwise(F.array().cast(f"array<{element}>"))

    head = F.array(F.lit(None).cast(element))
    dealt = tried.select(*row, main.alias("main"), F.posexplode(F.concat(
        head, *[signed(i, number, other) for i, (number, other) in enumerate(gaps.items())]
    )).alias("at", "e")).select(*row, F.when(F.col("at") == 0, F.col("main")).alias("main"), "e.*")
    side = lambda sign: F.collect_list(F.when(F.col("sign") == sign, F.col("d")))
    blocks = dealt.groupBy(*row, "what", "block").agg(
        F.first("main", ignorenulls=True).alias("main"), side(1).alias("one"), side(-1).alias("other")
    )
    peeled = compute_once(blocks, {"gap": F.size(differing(
        F.col("one"), F.col("other"), table(F.col("one"), 1), table(F.col("other"), 1)
    ))})
    summed = peeled.groupBy(*row).agg(
        F.first("main", ignorenulls=True).alias("main"),
        *[F.sum(F.when(F.col("what") == i, F.col("gap"))).cast("int").alias(f"sum_{c}") for i, c in enumerate(gaps)],
    )
    return summed.select(
        *row, *[f"main.{c}" for c in kept], *[F.coalesce(f"main.{c}", f"sum_{c}").alias(c) for c in gaps]
    )


def compare_versions(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against an edited version of it and against the next text.

    The next text is that of the next smaller key (after the smallest, the largest's). The edited text has its last
    half of code points replaced by the first as many, or all, of the next text. Result: ``key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_differing``, the
    last being the paragraphs recovered between the two versions. Null text is empty; rows
    without a key have no place in the order and are left out; equal keys follow each other
    by content. A single row is its own next.
    """
    def made(frame: DataFrame) -> DataFrame:
        cut = compute_once(frame, {"own": digests(F.col("value"))})
        return compute_once(cut, {"cells": table(F.col("own"), BLOCKS[0])})

    rows = with_next(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")), key, "text", made)
    n = F.char_length("text")
    kept = n - F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("next", F.lit(1), n - kept))
    read = compute_once(rows, {"edited": edited, "n_chars": n.cast("long")})
    cut = compute_once(read, {
        "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "changed": digests(F.col("edited")),
    }).drop("text", "next", "edited")
    tabled = compute_once(cut, {"changed_cells": table(F.col("changed"), BLOCKS[0])})
    tried = compute_once(tabled, {
        "fingerprint": as_text(F.col("cells")), "edited_fingerprint": as_text(F.col("changed_cells")),
        "n_own": F.size("own"), "n_changed": F.size("changed"), "n_next": F.size("next_own"),
        "edited_gap": F.size(peel(subtract(F.col("cells"), F.col("changed_cells")))),
        "next_gap": F.size(peel(subtract(F.col("cells"), F.col("next_cells")))),
    })
    peeled = _larger_tables(
        tried, ["bucket", "place"], {"edited_gap": "changed", "next_gap": "next_own"},
        [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "n_own", "n_changed", "n_next"],
    )
    return peeled.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("n_own"), F.col("n_changed"), F.col("edited_gap")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("n_next"), F.col("next_gap")).alias("near_next"),
        F.col("edited_gap").alias("n_differing"),
    )
