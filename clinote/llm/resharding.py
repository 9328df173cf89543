"""Resharding by minimum-cost flow (operator 2).

The bytes of the old shards flow to the new ones, whose capacities are given. A byte that
stays costs nothing, any other one (or what a cost table says), and the cheapest flow is found
by successive shortest paths on the graph of shards, which is as small as their number.

Rows follow the flow in the order of a hash of their key: a transfer takes a range of
hashes of an old shard, most of it whole blocks (hash prefixes), and the borders fall between
two rows. So the plan is a few ranges per old shard, and a row finds its new shard by an
expression. Large rows are cut into ranges first and small ones last, and what the large
ones left over or took too much is made good by the small: new sizes meet the capacities
within a few small rows. Only shards whose rows change are written anew.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinote.session import store

BLOCKS = 256
#: Rows are placed in layers: of at least so many bytes, then the next, then the rest.
LAYER_BYTES = (65_536, 4_096, 512)
_HASHES = 1 << 60
PART_BYTES, MAX_GROUPS = 64 << 20, 1_000_000


def min_cost_flow(
    supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]
) -> list[list[int]]:
    """The cheapest transfers that move all supply within the capacities.

    Successive shortest paths with potentials: each path is found by Dijkstra's algorithm on
    the residual graph and filled to its narrowest place.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    high = [0] * (n + m)
    while any(left):
        distance: list[float] = [float("inf")] * (n + m)
        before = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, node = heapq.heappop(heap)
            if d > distance[node]:
                continue
            if node < n:
                arcs = [(n + j, cost[node][j]) for j in range(m)]
            else:
                arcs = [(i, -cost[i][node - n]) for i in range(n) if flow[i][node - n]]
            for to, price in arcs:
                ahead = d + price + high[node] - high[to]
                if ahead < distance[to]:
                    distance[to], before[to] = ahead, node
                    heapq.heappush(heap, (ahead, to))
        end = min((n + j for j in range(m) if room[j]), key=lambda t: distance[t] + high[t])
        top = max(d for d in distance if d < float("inf"))
        high = [h + min(d, top) for h, d in zip(high, distance)]
        path, node = [], end
        while before[node] >= 0:
            path.append((before[node], node))
            node = before[node]
        amount = min([left[node], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[node] -= amount
        room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclasses.dataclass(frozen=True)
class Plan:
    """``ranges[old, layer]`` are ``(end, new)``: rows of hashes below ``end``, and not before, go to ``new``."""

    ranges: dict[tuple[int, int], list[tuple[int, int]]]
    flow: dict[tuple[int, int], int]

    def affected(self) -> list[int]:
        """Shards that give or take rows."""
        return sorted({s for (old, new), amount in self.flow.items() if amount and old != new for s in (old, new)})


def row_size(text: str = "text", overhead: int = 8) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed number more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def _old(old: str) -> Column:
    """Number of the old shard; rows without one are taken to lie in shard 0."""
    return F.coalesce(F.col(old).cast("int"), F.lit(0))


def _hash(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("reshard"), F.col(key)), F.lit(_HASHES))


def _layer() -> Column:
    return reduce(
        lambda rest, k: F.when(F.col("size") >= LAYER_BYTES[k], k).otherwise(rest),
        range(len(LAYER_BYTES) - 1, -1, -1), F.lit(len(LAYER_BYTES)),
    )


def _block() -> Column:
    return F.floor(F.col("hash") / (_HASHES // BLOCKS)).cast("int")


def _cuts(rows: DataFrame, layer: int, wanted: dict[tuple[int, int], list[tuple[int, int]]]) -> dict:
    """The first hash behind each cut and the bytes before it in its block.

    ``wanted`` has, for an old shard and a block, the cuts by number and the bytes of the block before each.
    """
    spark = rows.sparkSession
    asked = [(old, block, number, at) for (old, block), cuts in wanted.items() for number, at in cuts]
    if not asked:
        return {}
    # As many rows as there are transfers.
    cuts = spark.createDataFrame(asked, "old int, block int, number int, wanted long")
    before = Window.partitionBy("old", "block").orderBy("hash").rangeBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.filter(F.col("layer") == layer)
        .join(cuts.select("old", "block").distinct(), ["old", "block"], "left_semi")
        .groupBy("old", "block", "hash").agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    )
    # A row goes to the side on which most of it lies.
    late = F.col("before") + F.col("size") / 2 >= F.col("wanted")
    found = placed.join(cuts, ["old", "block"]).filter(late).groupBy("old", "number").agg(
        F.min(F.struct("hash", "before")).alias("cut")
    )
    return {(r["old"], r["number"]): (r["cut"]["hash"], r["cut"]["before"]) for r in found.collect()}


def plan(
    df: DataFrame, old: str, capacities: Sequence[int] | int, *, key: str = "doc_id", text: str = "text",
    costs: Sequence[Sequence[int]] | None = None,
) -> Plan:
    """Transfers from the shards in column ``old`` (numbers from 0) to new ones of the given capacities.

    A single number of shards means equal capacities. ``costs[old][new]`` is the price of a
    byte; by default 0 for a shard that stays and 1 otherwise, so the fewest bytes move.
    Rows that share a key go together; rows without one are treated as one key, rows without an old shard
    as rows of shard 0. What reaches
    the driver are sizes per shard, layer and block.
    """
    rows = df.select(_old(old).alias("old"), _hash(key).alias("hash"), row_size(text).alias("size"))
    rows = store(df.sparkSession, rows.withColumns({"layer": _layer(), "block": _block()}), "row-sizes")
    sums: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for r in rows.groupBy("old", "layer", "block").agg(F.sum("size").alias("bytes")).collect():
        sums[r["old"], r["layer"]][r["block"]] = r["bytes"]
    olds = sorted({o for o, _ in sums})
    supply = [sum(sum(sums[o, k].values()) for k in range(len(LAYER_BYTES) + 1)) for o in olds]
    if isinstance(capacities, int):
        capacities = equal_capacities(sum(supply), capacities)
    price = [[costs[o][n] if costs else int(o != n) for n in range(len(capacities))] for o in olds]
    flow = min_cost_flow(supply, capacities, price)
    left = {(o, n): flow[i][n] for i, o in enumerate(olds) for n in range(len(capacities)) if flow[i][n]}
    planned, ranges = dict(left), {}
    for layer in range(len(LAYER_BYTES) + 1):
        parts, wanted = {}, defaultdict(list)
        for o in olds:
            blocks = sums.get((o, layer), {})
            here = sum(blocks.values())
            targets = [n for n in range(len(capacities)) if (o, n) in left]
            total = sum(max(0, left[o, n]) for n in targets)
            if not here or not targets:
                continue
            # The layer's bytes in proportion to what is still to go to each shard.
            at, ends = 0.0, []
            for n in targets:
                at += here * max(0, left[o, n]) / total if total else here / len(targets)
                ends.append(int(at))
            parts[o] = (targets, ends, blocks, here)
            for number, end in enumerate(ends[:-1]):
                before = 0
                for block in sorted(blocks):
                    if before + blocks[block] > end:
                        wanted[o, block].append((number, end - before))
                        break
                    before += blocks[block]
        cuts = _cuts(rows, layer, wanted)
        for o, (targets, ends, blocks, here) in parts.items():
            borders, sums_before = [], []
            for number in range(len(targets) - 1):
                block = next((b for (x, b), c in wanted.items() if x == o and number in [k for k, _ in c]), None)
                hash_, inside = cuts.get((o, number), (None, None))
                if block is None:  # nothing lies behind this border
                    borders.append(_HASHES)
                    sums_before.append(here)
                    continue
                whole = sum(v for b, v in blocks.items() if b < block)
                if hash_ is None:  # the whole block lies before the border
                    borders.append((block + 1) * (_HASHES // BLOCKS))
                    sums_before.append(whole + blocks[block])
                else:
                    borders.append(hash_)
                    sums_before.append(whole + inside)
            borders.append(_HASHES)
            sums_before.append(here)
            ranges[o, layer] = list(zip(borders, targets))
            for n, high, low in zip(targets, sums_before, [0, *sums_before]):
                left[o, n] -= high - low
    return Plan(ranges, planned)


def assign(df: DataFrame, old: str, made: Plan, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``shard``, the number of its new shard, and the row's ``layer, block, hash`` in the old one."""
    spark = df.sparkSession
    rows = [(o, layer, [e for e, _ in r], [n for _, n in r]) for (o, layer), r in made.ranges.items()]
    table = spark.createDataFrame(rows, "__old int, __layer int, ends array<long>, news array<int>")
    marked = df.withColumns({"hash": _hash(key), "size": row_size(text)}).withColumns({"layer": _layer(), "block": _block()})
    # A few numbers per old shard and layer: the bound is the number of shards.
    joined = marked.join(
        F.broadcast(table), (_old(old) == F.col("__old")) & (F.col("layer") == F.col("__layer"))
    )
    passed = F.size(F.filter("ends", lambda end: end <= F.col("hash")))
    return joined.withColumn("shard", F.get("news", passed)).drop("__old", "__layer", "ends", "news")


def _parts(made: Plan) -> int:
    """Hash ranges that a new shard is cut into, of about ``PART_BYTES`` each."""
    news = len({new for _, new in made.flow}) or 1
    parts = -(-sum(made.flow.values()) // (news * PART_BYTES))
    return max(16, min(parts, MAX_GROUPS // (news * max(1, len(made.ranges)))))


def _numbered(placed: DataFrame, key: str, made: Plan) -> DataFrame:
    """``key, text, old, slot, shard`` with slots that are gapless from 0 within a shard."""
    group, parts = ["shard", "part", "old", "layer"], _parts(made)
    cut = placed.withColumn("part", F.floor(F.col("hash") / (_HASHES // parts)).cast("int"))
    counted = cut.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "old", "layer").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_GROUPS rows, whatever the data.
    firsts = counted.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*group).orderBy("hash", key)
    # Partitions of a quarter of a range's bytes on average, so that few large ranges meet in one.
    n = max(32, min(4 * sum(made.flow.values()) // PART_BYTES, MAX_GROUPS))
    dealt = cut.repartition(n, "shard", "part")
    return (
        dealt.withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(firsts), group)
        .select(key, "text", "old", (F.col("first") + F.col("row")).alias("slot"), "shard")
    )


def _shards_and_rows(df: DataFrame, old: str, made: Plan, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias(key), F.col(text).alias("text"), _old(old).alias("old"))
    return assign(rows, "old", made, key=key)


def rewrite(
    df: DataFrame, old: str, made: Plan, path: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the affected shards to ``path`` (a folder ``shard=n`` each) and return the written table.

    Columns: ``key, text, old, shard, slot``; slots are gapless from 0 within a shard. Rows of
    shards that neither give nor take are not touched (``untouched`` has them). Hash ranges cut a shard into parts of
    about ``PART_BYTES`` that are written side by side, so no shard passes through one task.
    """
    affected = made.affected()
    placed = _shards_and_rows(df, old, made, key, text).filter(F.col("shard").isin(affected))
    _numbered(placed, key, made).write.partitionBy("shard").parquet(path)
    kind = dict(df.dtypes)[key]
    return df.sparkSession.read.schema(f"`{key}` {kind}, text string, old int, slot long, shard int").parquet(path)


def untouched(df: DataFrame, old: str, made: Plan, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the shards that neither give nor take, as ``rewrite`` gives those of the others.

    With ``rewrite``'s rows they are all rows of ``df``. Their shards keep their files; slots are numbered as there.
    """
    kept = sorted({new for _, new in made.flow} - set(made.affected()))
    placed = _shards_and_rows(df, old, made, key, text).filter(F.col("shard").isin(kept))
    return _numbered(placed, key, made)
