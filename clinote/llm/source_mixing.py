"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 11).

The documents of a source lie end to end in the order of a hash, and this stream of words, begun
anew where a source is taken more than once, is cut into blocks of equal length. A source's target
is a quota of blocks. The tree splits the quotas of all sources, as exact whole numbers, between
the two halves of the output shards, and each half again, down to single shards: at each node the
left half's share of every source is drawn from the multivariate hypergeometric distribution, so
a shard holds what an even shuffle of all blocks would have given it, without one. A shard
then takes its quota of a source from a permutation of its blocks, disjoint from that of any other
shard, and shuffles its blocks by itself. All draws are hashes, so a rerun gives the same mix.

All of it is column expressions. A tree node is a row that holds one number per source.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinote.functions.columns import compute_once
from clinote.session import store

WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, SEED = 4096, 1024, 11
#: Words are what lies between blanks, tabs and line ends of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS, _COPIES = 4096, 4096
#: A prime beyond any number of blocks of a source, so that its multiples permute them.
_PRIME = 2_654_435_761


@dataclasses.dataclass(frozen=True)
class Mix:
    """``sources``: a row per source with its target; ``rows``: a row per document with its place in its
    source; ``pieces``: which words of which document lie where in which shard."""

    sources: DataFrame
    rows: DataFrame
    pieces: DataFrame


def n_words(text: str = "text") -> Column:
    """Number of words; none in a null text."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """``source, size, number, target``: words that the mix shall take of each source.

    ``sizes`` has a row per ``source`` with its ``size``. Sources by code point, null last, take the
    weights in turn and share ``share`` times all words. A target stops at ``most_repeats`` times its source and the excess
    is shared again by weight. What that ends in is found directly: in the order of words a weight, a source
    is full exactly if its own share of what the ones before it left is not below its limit.
    One task has a row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("number", F.row_number().over(by_name) - 1).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")),
        "limit": F.col("size") * F.lit(float(most_repeats)),
    })
    by_need = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before, onwards = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onwards)
    levelled = numbered.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("weight") >= F.col("limit"))
    common = F.max(F.when(~F.col("is_full"), F.col("level"))).over(Window.partitionBy())
    return levelled.select(
        "source", "size", "number",
        F.when(F.col("is_full"), F.col("limit")).otherwise(F.col("weight") * common).alias("target"),
    )


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are ``marked``, by inversion of a uniform number.

    The distribution is summed from 12 standard deviations and 10 below its mean to as many above, where what is
    left out is less than a double can tell from nothing; each probability follows from the one before.
    """
    least, most = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    mean = drawn.cast("double") * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(
        mean * (1 - marked / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)
    ))
    parts = F.struct(
        F.greatest(least, F.floor(mean - 12 * spread - 10)).alias("low"),
        F.least(most, F.ceil(mean + 12 * spread + 10)).alias("high"),
        total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), uniform.alias("uniform"),
    )

    def chosen(v: Column) -> Column:
        span = F.sequence(v["low"], v["high"])

        def after(p: Column, k: Column) -> Column:
            up = (v["marked"] - k).cast("double") * (v["drawn"] - k)
            return p * up / ((k + 1).cast("double") * (v["total"] - v["marked"] - v["drawn"] + k + 1))

        mass = F.aggregate(
            span, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda s, k: F.struct(after(s["p"], k).alias("p"), (s["sum"] + s["p"]).alias("sum")),
            lambda s: s["sum"],
        )

        def pick(wanted: Column) -> Column:
            return F.aggregate(
                span, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), v["low"].alias("k")),
                lambda s, k: F.struct(
                    after(s["p"], k).alias("p"), (s["sum"] + s["p"]).alias("sum"),
                    F.when(s["sum"] + s["p"] <= wanted, k + 1).otherwise(s["k"]).alias("k"),
                ),
                lambda s: F.least(s["k"], v["high"]),
            )

        return F.element_at(F.transform(F.array(mass * v["uniform"]), pick), 1)

    return F.element_at(F.transform(F.array(parts), chosen), 1)


def _uniform(*seed: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    values = [F.lit(s) if isinstance(s, int) else s for s in seed]
    return F.shiftrightunsigned(F.xxhash64(*values), 11) / float(1 << 53)


def _left_quotas(seed: int) -> Column:
    """Blocks of every source that go to the left half of a node, which takes ``n_left`` blocks in all."""
    start = F.struct(
        F.aggregate("quotas", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"),
        F.col("n_left").alias("drawn"), F.array().cast("array<long>").alias("out"),
    )

    def draw(state: Column, number: Column) -> Column:
        marked = F.get("quotas", number)
        taken = hypergeometric(
            state["total"], marked, state["drawn"], _uniform(seed, F.col("first"), F.col("last"), number)
        )
        return F.element_at(F.transform(F.array(taken), lambda k: F.struct(
            (state["total"] - marked).alias("total"), (state["drawn"] - k).alias("drawn"),
            F.concat(state["out"], F.array(k)).alias("out"),
        )), 1)

    return F.aggregate(F.sequence(F.lit(0), F.size("quotas") - 1), start, draw, lambda state: state["out"])


def split_quotas(quotas: DataFrame, n_shards: int, *, seed: int = SEED) -> DataFrame:
    """``shard, number, first, quota``: the blocks of every source that each shard takes, from its ``first`` on.

    ``quotas`` has ``number`` (sources from 0, without gaps) and ``blocks``. Shards take equally many blocks, at most one apart.
    """
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("number", "blocks"))), lambda s: s["blocks"])
    nodes = quotas.agg(gathered.alias("quotas")).filter(F.size("quotas") > 0).select(
        F.lit(0).alias("first"), F.lit(n_shards).alias("last"), "quotas",
        F.transform("quotas", lambda q: F.lit(0).cast("long")).alias("starts"),
        F.aggregate("quotas", F.lit(0).cast("long"), lambda a, b: a + b).alias("all"),
    )

    def reach(shard: Column) -> Column:
        """Blocks of all shards before one; in whole numbers."""
        whole, rest = F.floor(F.col("all") / n_shards), F.col("all") % n_shards
        return whole * shard + F.least(rest, shard.cast("long"))

    for _ in range((n_shards - 1).bit_length()):
        middle = F.floor((F.col("first") + F.col("last") + 1) / 2).cast("int")
        halved = nodes.withColumn("middle", middle).withColumn("n_left", reach(F.col("middle")) - reach(F.col("first")))
        drawn = compute_once(halved, {"left": _left_quotas(seed)})
        left = F.struct(F.col("first"), F.col("middle").alias("last"), F.col("left").alias("quotas"), F.col("starts"))
        right = F.struct(
            F.col("middle").alias("first"), F.col("last"),
            F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas"),
            F.zip_with("starts", "left", lambda a, b: a + b).alias("starts"),
        )
        halves = F.when(F.col("middle") < F.col("last"), F.array(left, right)).otherwise(F.array(left))
        nodes = drawn.select("all", F.inline(halves))
    each = F.arrays_zip(F.col("starts").alias("start"), F.col("quotas").alias("quota"))
    return nodes.select(F.col("first").alias("shard"), F.posexplode(each).alias("number", "each")).select(
        "shard", "number", F.col("each.start").alias("first"), F.col("each.quota").alias("quota")
    ).filter("quota > 0")


def _placed(documents: DataFrame, key: str, text: str, source: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the stream of their source, and a row per source with its size.

    Equal rows are counted first and dealt out after, so that no number of copies meets in one task.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(text).alias("size"),
                            F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("hash"))
    counted = store(spark, rows.groupBy("source", "key", "size", "hash").agg(F.count("*").alias("n")), "mix-rows")
    sizes = store(spark, counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), "mix-sizes")
    numbers = sizes.select("source", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("number"))
    numbers = numbers.select(F.col("source").alias("same"), (F.col("number") - 1).alias("number"))
    dealt = counted.join(numbers, F.col("source").eqNullSafe(F.col("same"))).drop("same").withColumn(
        "bucket", F.pmod("hash", F.lit(_BUCKETS))
    )
    sums = dealt.groupBy("number", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows"))
    smaller = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most _BUCKETS rows per source.
    offsets = sums.select("number", "bucket", *[
        F.coalesce(F.sum(c).over(smaller), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")
    ])
    inside = Window.partitionBy("number", "bucket").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    rows_before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    laid = (
        dealt.withColumns({"words": words, "rows": rows_before}).join(offsets, ["number", "bucket"])
        .select("number", "key", "size", "hash", "n", (F.col("words_before") + F.col("words")).alias("start"),
                (F.col("rows_before") + F.col("rows")).alias("row"))
    )
    laid = store(spark, laid, "mix-places")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    few = laid.filter(F.col("n") <= _COPIES).select("*", copy)
    # Many copies of a row are cut into groups, which are dealt to tasks before they are counted out.
    group = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES))).alias("group")
    many = laid.filter(F.col("n") > _COPIES).select("*", group).repartition("number", "row", "group").select(
        *laid.columns,
        F.explode(F.sequence(
            F.col("group") * _COPIES, F.least(F.col("n"), (F.col("group") + 1) * _COPIES) - 1
        )).alias("copy"),
    )
    each = few.unionByName(many).select(
        "number", (F.col("row") + F.col("copy")).alias("row"), "key", "size", "hash",
        (F.col("start") + F.col("copy") * F.col("size")).alias("start"),
    )
    return each, sizes


def mix(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, n_shards: int | None = None, seed: int = SEED,
) -> Mix:
    """The mix of all documents.

    ``pieces`` has ``number`` and ``row`` (the document), ``key, hash``, ``repeat`` (from 0), ``first_word`` and ``last_word``
    (from 0, behind the last), ``shard``, ``place`` (the order of blocks in the shard) and ``at`` (that of pieces in a block).
    A source gives the whole words of its target; no word is given more than ``most_repeats`` times. A null text has no words,
    a null source is a source, rows without a key or with equal keys are documents of their own. Equal rows
    differ only in their place. An empty table, or one without words, gives no pieces. A source has fewer
    than 2^31 blocks; all sources together fit into one row.
    """
    spark = documents.sparkSession
    rows, sizes = _placed(documents, key, text, source, seed)
    rows = store(spark, rows, "mix-documents")
    sources = targets(sizes, weights=weights, share=share, most_repeats=most_repeats).withColumn(
        "words", F.floor("target")
    ).withColumn("blocks", F.ceil(F.col("words") / block_words))
    sources = store(spark, sources, "mix-sources")
    if n_shards is None:
        n_shards = max(1, -(-(sources.agg(F.sum("blocks")).first()[0] or 0) // shard_blocks))
    quotas = split_quotas(sources.select("number", "blocks"), n_shards, seed=seed)
    taken = quotas.join(sources.select("number", "blocks"), "number").select(
        "shard", "number", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("drawn")
    )
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col("number")), F.col("blocks"))
    block = (F.col("drawn") * F.pmod(F.lit(_PRIME), F.col("blocks")) + shift) % F.col("blocks")
    blocks = taken.select("shard", "number", block.alias("block"))
    blocks = blocks.withColumn("place", F.xxhash64(F.lit(seed), "shard", "number", "block"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("repeat")
    begin = F.col("start") + F.col("repeat") * F.col("source_size")
    spans = (
        rows.filter("size > 0").join(sources.select("number", F.col("size").alias("source_size"), "words"), "number")
        .select("*", passes).withColumn("begin", begin).filter("begin < words")
        .withColumn("end", F.least(F.col("begin") + F.col("size"), "words"))
    )
    cut = spans.select("*", F.explode(F.sequence(
        F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)
    )).alias("block"))
    met = cut.join(blocks, ["number", "block"])
    first = F.greatest(F.col("begin"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    pieces = met.select(
        "number", "row", "key", "hash", "repeat", (first - F.col("begin")).alias("first_word"),
        (last - F.col("begin")).alias("last_word"), "shard", "place", (first - F.col("block") * block_words).alias("at"),
    )
    return Mix(sources, rows, pieces)


def taken_words(made: Mix) -> DataFrame:
    """``key, size, source_size, target, taken``: a row per document, the words that the mix takes of it."""
    key = ["number", "row", "key", "size"]
    none = made.rows.select(*key, F.lit(0).cast("long").alias("words"))
    given = made.pieces.select(
        "number", "row", "key", F.lit(None).cast("long").alias("size"), (F.col("last_word") - F.col("first_word")).alias("words")
    )
    counted = none.unionByName(given).groupBy("number", "row", "key").agg(
        F.max("size").alias("size"), F.sum("words").alias("taken")
    )
    sources = made.sources.select("number", F.col("size").alias("source_size"), "target")
    return counted.join(sources, "number").select("key", "size", "source_size", "target", "taken")


def write(
    documents: DataFrame, made: Mix, path: str, *, key: str = "doc_id", text: str = "text", seed: int = SEED
) -> None:
    """Write the texts of the mix to ``path``, a folder per shard, each shuffled by itself.

    A piece's words are joined by single blanks. The text meets its pieces by a hash of key and text.
    """
    texts = documents.select(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("hash"),
                             F.col(f"`{text}`").alias("text")).dropDuplicates(["hash"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.slice(words, (F.col("first_word") + 1).cast("int"), (F.col("last_word") - F.col("first_word")).cast("int"))
    met = made.pieces.join(texts, "hash").select("shard", "place", "at", F.array_join(cut, " ").alias("text"))
    met.repartition("shard").sortWithinPartitions("shard", "place", "at").write.partitionBy("shard").parquet(path)
