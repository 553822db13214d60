"""A sieve ahead of a shuffle: a bit table that every task holds tells the rows whose key is surely not wanted, so that
these stay where they are. What it lets through is for an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 15  # bits in a row of the table, as a power of two: what bitmap_construct_agg makes (4 KB)
BITS = (PART, 27)  # bits of the table likewise (16 MB at most); 64 or more for a key, while that suffices


def sieved(rows: DataFrame, by: Column, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the rows whose `by` may be among the keys, the rows whose `by` is not); by: a hash of 64 bits, never null, of
    the rows; keys: a column of about n such hashes. With more keys more rows pass, and no key is ever lost."""
    size = min(max((64 * n).bit_length(), BITS[0]), BITS[1])
    bit = lambda h: h.bitwiseAND(F.lit((1 << size) - 1))
    own = keys.toDF("h").select(bit(F.col("h")).alias("bit"))
    table = own.groupBy(F.shiftright("bit", PART).alias("__part")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << PART)).alias("__map"))
    marked = rows.withColumn("__bit", bit(by))
    byte = f"substring(__map, CAST((__bit % {1 << PART}) DIV 8 AS INT) + 1, 1)"
    known = (F.shiftright("__bit", PART) == F.col("__part")) & F.expr(f"getbit(CAST(conv(hex({byte}), 16, 10) AS INT), CAST(__bit % 8 AS INT)) = 1")
    maybe, none = (marked.join(F.broadcast(table), known, how).drop("__bit") for how in ("left_semi", "left_anti"))
    return maybe, none
