"""Bitmap tables: for every value of a column and every stretch of 32,768 keys, one bit a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import CompareOp


def build(df: DataFrame, value: str, key: str) -> DataFrame:
    """(value, bucket, bits). Rows without a value have a place but no bit. Keys must not be negative."""
    rows = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    return rows.groupBy(F.col(value).alias("value"), F.bitmap_bucket_number(F.col(key)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("bits"))


def run(bitmaps: DataFrame, condition: Column) -> DataFrame:
    """(bucket, bits) of the rows whose value satisfies a condition on `value`."""
    return bitmaps.filter(condition).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def compare(bitmaps: DataFrame, op: CompareOp, value) -> DataFrame:
    v, x = F.col("value"), F.lit(value)
    return run(bitmaps, {CompareOp.EQ: v == x, CompareOp.LT: v < x, CompareOp.LE: v <= x, CompareOp.GT: v > x, CompareOp.GE: v >= x}[CompareOp(op)])


def between(bitmaps: DataFrame, low, high) -> DataFrame:
    return run(bitmaps, F.col("value").between(low, high))


def prefix(bitmaps: DataFrame, p: str) -> DataFrame:
    return run(bitmaps, F.col("value").startswith(p))


def union(*operands: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, operands).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(*operands: DataFrame) -> DataFrame:
    """A bucket that an operand lacks is empty in the result."""
    both = reduce(DataFrame.unionByName, operands).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter(F.col("n") == len(operands)).drop("n")


def complement(bitmaps: DataFrame, operand: DataFrame) -> DataFrame:
    """Rows that have a value and are not in the operand: the values' union without it, bit by bit."""
    whole = run(bitmaps, F.lit(True))
    return keys(whole).join(keys(operand), "key", "left_anti").groupBy(F.bitmap_bucket_number("key").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits"))


def count(operand: DataFrame) -> DataFrame:
    """One row: `n`, without making a key."""
    return operand.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def keys(operand: DataFrame) -> DataFrame:
    """The keys whose bits are set, ascending within a bucket."""
    byte = F.posexplode(F.split(F.hex("bits"), "(?<=\\G..)")).alias("byte", "hex")
    some = operand.select("bucket", byte).filter("hex not in ('00', '')").select("bucket", "byte", F.conv("hex", 16, 10).cast("int").alias("v"))
    bit = some.withColumn("bit", F.explode(F.array(*map(F.lit, range(8))))).filter(F.expr("(shiftright(v, bit) & 1) = 1"))
    # bucket 0 holds 0 and what lies below it; bucket b > 0 holds 32768 (b - 1) + 1 to 32768 b
    place = F.col("byte") * 8 + F.col("bit")
    return bit.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + place).otherwise(F.col("bucket") * 32768 + place).cast("long").alias("key"))


def decode(bitmaps: DataFrame) -> DataFrame:
    """(value) dictionary, ascending."""
    return bitmaps.select("value").distinct().orderBy("value")
