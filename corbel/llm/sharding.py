"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts are one indivisible group. Differencing keeps a heap of
partial partitions (a load for each shard) and combines the two with the largest
spread, the heaviest load of one with the lightest of the other, until one is
left; this balances bytes far more tightly than filling the lightest shard.

Differencing is sequential, so it runs over a bounded number of items that stand
for all groups. A group above 1/64 of a shard's share is an item by itself (at
most 64 x shards of them). The others are pooled by hash, in grains: most into
4096 coarse pools, a sixteenth of the rest into 4096 finer ones, and so on, until
few enough are left to be items themselves. Coarse pools are placed first by
their spread and fine ones settle the difference, so loads come out within a few
bytes, whatever the sizes of groups are. The number of items grows with the
logarithm of the number of groups; pools are sums that are taken before the
shuffle, and no group is collected anywhere.

Rows are told apart by their place in the table, so a group that holds a third of
all rows is dealt out by rows, but for its one sum. Defined results: a null text
has size 8, no checksum, and its rows are one group; repeated rows stay together;
an empty table gives an empty result; further columns, whatever their names, are
kept by `sharded`.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keyed, shuffled, staged

SHARDS = 24
POOLS = 4096
GRAIN = 16


def differencing(weights: Sequence[int], ways: int) -> list[int]:
    """The part (0 to ways - 1) of each weight, by the largest differencing method; ties by position."""
    n = len(weights)
    if not n:
        return []
    loads: list[list[int]] = [[w] + [0] * (ways - 1) for w in weights]  # from the heaviest down
    made: list[tuple[int, int, list[int]]] = []  # of a combined partition: its two sides, and which slot each load had before sorting
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = loads[a], loads[b]
        raw = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(ways), key=raw.__getitem__, reverse=True)
        now = [raw[k] for k in order]
        loads[a] = loads[b] = []
        low = now[-1]  # only differences matter
        now = [v - low for v in now]
        made.append((a, b, order))
        loads.append(now)
        heapq.heappush(heap, (-now[0], n + len(made) - 1))
    part = [0] * n
    slots: dict[int, list[int]] = {n + len(made) - 1: list(range(ways))}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[node - n]
        mine = slots.pop(node)
        raw = [0] * ways
        for k, slot in enumerate(order):
            raw[slot] = mine[k]
        for child, its in ((a, raw), (b, raw[::-1])):
            if child < n:
                part[child] = its[0]
            else:
                slots[child] = its
    return part


def _grain(key: Column, levels: int) -> Column:
    """Level of a group, from 0: each holds 1 / GRAIN of the one before."""
    h = F.pmod(F.xxhash64(F.lit("grain"), key), F.lit(GRAIN**levels)) if levels else F.lit(0)
    out = F.lit(levels)
    for level in range(levels - 1, -1, -1):
        out = F.when(h >= GRAIN ** (levels - 1 - level), level).otherwise(out)
    return out


def shards(docs: DataFrame, count: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: f and r (its place in the table), _id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    return _shards(*keyed(docs), count, doc_id, text)


def _placed(docs: DataFrame, file: str, row: str, count: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    group = F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit("00")))
    slim = docs.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col(doc_id).alias("_id"), size.alias("size"), F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"), group.alias("_group"))
    slim = staged(slim, "groups")
    groups = staged(slim.groupBy("_group").agg(F.sum("size").alias("w")), "weights")
    whole, n = groups.agg(F.sum("w"), F.count("*")).first()
    heavy_bar = max(1, (whole or 0) // (64 * count))
    heavy = groups.filter(F.col("w") > heavy_bar)  # at most 64 x count rows, as their weights add up to `whole` at most
    levels = 0
    while n > POOLS * GRAIN**levels:
        levels += 1
    # The last level's groups are few; a pool of its own for each, but for collisions.
    level = _grain(F.col("_group"), levels)
    pool = F.when(level == levels, F.pmod(F.xxhash64("_group"), F.lit(1 << 30))).otherwise(F.pmod(F.xxhash64("_group"), F.lit(POOLS)))
    keyed_ = lambda df: df.withColumns({"_level": level, "_pool": pool})
    pools = keyed_(groups.filter(F.col("w") <= heavy_bar)).groupBy("_level", "_pool").agg(F.sum("w").alias("w"))
    items = [(bytes(r["_group"]), -1, -1, r["w"]) for r in heavy.collect()] + [(None, r["_level"], r["_pool"], r["w"]) for r in pools.collect()]
    items.sort(key=lambda x: (-x[3], x[1], x[2], x[0] or b""))
    part = differencing([x[3] for x in items], count)
    placed = [(*x[:3], s) for x, s in zip(items, part, strict=True)]
    # Both are bounded: 64 x count groups, and POOLS for each level or so.
    heavy_at = spark.createDataFrame([(bytearray(g), s) for g, _, _, s in placed if g], "_g binary, _hs int")
    pool_at = spark.createDataFrame([(le, p, s) for g, le, p, s in placed if not g], "_l int, _p bigint, _ps int")
    rows = keyed_(slim).join(F.broadcast(heavy_at), F.col("_group") == F.col("_g"), "left")
    rows = rows.join(F.broadcast(pool_at), (F.col("_level") == F.col("_l")) & (F.col("_pool") == F.col("_p")), "left")
    return rows.select("f", "r", "_id", "size", "text_crc32", F.coalesce("_hs", "_ps").alias("shard"))


def _shards(docs: DataFrame, file: str, row: str, count: int, doc_id: str, text: str) -> DataFrame:
    rows = _placed(docs, file, row, count, doc_id, text)
    # Slots: rows are numbered in small buckets of a shard, and each bucket starts where those before it end.
    buckets = max(64, docs.count() // (count * 5_000))
    bucket = F.pmod(F.xxhash64("_id", "text_crc32", "f", "r"), F.lit(buckets)).cast("int")
    rows = staged(rows.withColumn("_bucket", bucket), "placed")
    starts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "text_crc32", "size", "f", "r"))
    # The window has dealt the rows by shard and bucket already; only the starts move.
    rows = shuffled(rows.withColumn("_nth", own), starts, ["shard", "_bucket"], ["_s", "_b"], "inner")
    return rows.select("f", "r", "_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"))


def sharded(docs: DataFrame, count: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their shard, in a column `shard` (a column of this name gives way); rows of equal text have the same one."""
    src, file, row = keyed(docs)
    f, r, s = fresh(src, "_at_file", "_at_row", "_shard")
    at = staged(_placed(src, file, row, count, doc_id, text).select(F.col("f").alias(f), F.col("r").alias(r), F.col("shard").alias(s)), "shards")
    kept = [c for c in docs.columns if c.lower() != "shard"]
    return shuffled(src, at, [file, row], [f, r], "inner").select(*kept, F.col(s).alias("shard"))


def op2_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, under the law `bytes`."""
    return shards(docs).select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
