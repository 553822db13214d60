"""Connected components by alternating stars, in DataFrame operations, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import forget, kept

HOT = 4096


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with a table that has each key once and, as `n`, how many of the `total` rows have it.

    No more than HOT keys can hold more than total / HOT rows each: these are broadcast, so their rows stay where they
    are, and only keys with fewer rows are shuffled. Rows whose key is null or not in the table are left out.
    """
    least = total // HOT + 64
    hot = table.filter(F.col(n) > least)
    keys = [key] if isinstance(key, str) else key
    often = rows.join(F.broadcast(hot), keys)  # HOT rows at most
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col(n) <= least), keys)
    return often.unionByName(rest)


def _least(edges: DataFrame, own: bool, total: int) -> DataFrame:
    """The edges (u, v), with m: the least neighbour of u (or u itself, if own)."""
    m = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # combines before the shuffle
    m = m.withColumn("m", F.least("u", "m")) if own else m
    return looked_up(edges, m, "u", "n", total).drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Neighbours above a node move to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, True, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Neighbours below a node, and the node, move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down, False, total)
    return found.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of all ends of the edges (two columns of longs); the label is the least node of its component.

    Self loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows. The number of
    rounds grows with the logarithm of the longest path; no task gathers the neighbours of a node that has many.
    """
    a, b = edges.columns
    e = kept(spark, edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null").distinct(), "edges")
    ends = kept(spark, e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")
    now, seen = (e.count(), 0), None
    while now != seen and now[0]:
        seen, old = now, e
        large = kept(spark, _large_star(old.filter("u <> v"), now[0]).distinct(), "edges")
        e = kept(spark, _small_star(large, now[0]).filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for done in (old, large):  # a round is read from its own files, on whatever executor
            forget(done)
    found = ends.join(e.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    out = kept(spark, found, "components")
    forget(e)
    forget(ends)
    return out
