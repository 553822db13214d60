"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns `vnodes` points of a ring of 2**32 positions. A row's position is a hash of its key, and
its arc ends at the next point clockwise, whose shard is its first choice. Every shard has a capacity; the rows
of an arc that find their shard full go on clockwise to the next point whose shard has room.

Rows of one arc have the same list of choices, so the ring is settled on the *counts* of the arcs: a table of
`shards * vnodes` numbers, whatever the input. The plan says which ranks of an arc belong to which shard, and at
which slot they start; rows are ranked within their arc and look the plan up. An arc of many rows (one key may hold
a third of them) is dealt by a draw into pieces of about PIECE rows, which are ranked side by side.

With `slack=0` the capacities add up to the number of rows and differ by at most one, so every shard is exactly
full: the law `rows`. With a positive slack shards may hold up to (1 + slack) of the mean, and fewer keys move
when a shard is added.
"""

from __future__ import annotations

import hashlib
import json
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.frames import shielded
from tessera.sources.shared import kept

RING = 1 << 32
CELLS = 1 << 12
PIECE = 1 << 20


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, ascending; a position taken twice goes to the lower shard."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:4], "big")
            taken.setdefault(at, shard)
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(rows * (1 + slack) / shards)] * shards


def settle(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    counts: rows of each arc; owners: the shard of each ring point. All arcs first offer their rows to their own
    point, in ring order; what is left moves one point clockwise, again and again, until nothing is left.
    """
    room, used = list(room), [0] * len(room)
    waiting = {arc: (0, n) for arc, n in sorted(counts.items()) if n}
    plan = []
    for step in range(len(owners)):
        for arc, (done, n) in list(waiting.items()):
            shard = owners[(arc + step) % len(owners)]
            take = min(n - done, room[shard])
            if take:
                plan.append((arc, done, done + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if done + take == n:
                del waiting[arc]
            else:
                waiting[arc] = (done + take, n)
        if not waiting:
            return plan
    raise ValueError("the capacities are smaller than the number of rows")


def _position(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RING))


def _table(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A small table from values, as one SQL literal."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def _with_arc(spark: SparkSession, df: DataFrame, key: str, points: list[tuple[int, int]]) -> DataFrame:
    """Adds __pos and __arc. The ring is cut into equal cells; a cell knows the few points inside it."""
    width, at = RING // CELLS, [p for p, _ in points]
    cells = []
    for c in range(CELLS):
        first, last = bisect_left(at, c * width), bisect_left(at, (c + 1) * width)
        cells.append((c, first, at[first:last]))
    table = _table(spark, cells, "__cell long, __first int, __inside array<long>")
    found = df.withColumn("__pos", _position(F.col(key))).withColumn("__cell", F.floor(F.col("__pos") / width))
    passed = F.size(F.filter("__inside", lambda p: p < F.col("__pos")))
    return (
        found.join(F.broadcast(table), "__cell")  # CELLS rows, however large the input
        .withColumn("__arc", F.pmod(F.col("__first") + passed, F.lit(len(points))).cast("int"))
        .drop("__cell", "__first", "__inside")
    )


def assign_shards(spark: SparkSession, df: DataFrame, key: str, shards: int, vnodes: int = 128, slack: float = 0.0, ties: list[str] | None = None) -> DataFrame:
    """df with `shard` (0 to shards-1) and `slot` (gapless from 0 within the shard).

    Nulls in the key hash like one more key, and repeated keys share a position; both are spread like any rows that
    overflow, and ranked by `ties` (default: none) within their piece. An empty table gives an empty table. Columns of
    df named `shard` or `slot` are replaced; all others stay, whatever their names. The rows are written to the shared
    folder once, with their arcs and draws, so that counting and ranking see the same.
    """
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    inside, restored = shielded(df.drop("shard", "slot"), key, *(ties or []))
    rows = _with_arc(spark, inside, key, points).withColumn("__draw", F.rand(29))
    rows = kept(spark, rows, "arcs")
    counts = {r[0]: r[1] for r in rows.groupBy("__arc").count().collect()}  # shards * vnodes numbers at most
    plan = settle(counts, owners, capacities(sum(counts.values()), shards, slack))
    table = _table(spark, plan, "__arc int, __from long, __to long, shard int, __base long")
    table = table.groupBy("__arc").agg(F.collect_list(F.struct("__from", "__to", "shard", "__base")).alias("__plan"))
    pieces = _table(spark, [(arc, -(-n // PIECE)) for arc, n in counts.items()], "__arc int, __pieces int")
    rows = rows.join(F.broadcast(pieces), "__arc").withColumn("__piece", F.floor(F.col("__draw") * F.col("__pieces")).cast("int"))
    sizes = rows.groupBy("__arc", "__piece").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__arc").orderBy("__piece")) - F.col("__n")
    starts = sizes.select("__arc", "__piece", before.alias("__before"))  # a row for each arc and PIECE rows
    order = Window.partitionBy("__arc", "__piece").orderBy("__pos", key, *(ties or []))
    ranked = rows.withColumn("__place", F.row_number().over(order) - 1).join(F.broadcast(starts), ["__arc", "__piece"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__place"))
    chosen = F.filter("__plan", lambda s: (s["__from"] <= F.col("__rank")) & (F.col("__rank") < s["__to"]))[0]
    found = (
        ranked.join(F.broadcast(table), "__arc")  # at most two entries for each ring point and step that fills a shard
        .withColumn("__hit", chosen)
        .withColumn("shard", F.col("__hit.shard"))
        .withColumn("slot", F.col("__hit.__base") + F.col("__rank") - F.col("__hit.__from"))
    )
    return restored(found, "shard", "slot")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the law `rows`. A null text has size 16 and the crc32 of no bytes, 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    thin = docs.select("doc_id", (F.length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    out = assign_shards(spark, thin, "doc_id", shards=40, ties=["text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
