"""Vector and key files: fvecs, ivecs, SOSD, npy and CSV, read in parallel where the format has fixed records."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import LogicalType, parsed
from tessera.sources.shared import kept


def _vecs_shape(path: str, size: int) -> tuple[int, int]:
    """(dimension, rows) of a file of int32 length and 4-byte numbers."""
    with open(path, "rb") as f:
        head = f.read(4)
    if len(head) < 4:
        raise ValueError(f"{path} is empty")
    dim = struct.unpack("<i", head)[0]
    if dim <= 0:
        raise ValueError(f"{path} has the dimension {dim}")
    if size % (4 * (dim + 1)):
        raise ValueError(f"{path} ends within a record")
    return dim, size // (4 * (dim + 1))


def _read_vecs(spark: SparkSession, path: str, kind: str, limit: int | None, rows_a_task: int = 1 << 16) -> DataFrame:
    dim, rows = _vecs_shape(path, os.path.getsize(path))
    rows = rows if limit is None else min(rows, limit)
    element = T.FloatType() if kind == "<f4" else T.IntegerType()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(element, False))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["at"]:
                n = min(rows_a_task, rows - at)
                raw = np.fromfile(path, "<i4", n * (dim + 1), offset=4 * at * (dim + 1)).reshape(n, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{path} has records of differing dimensions")
                yield pd.DataFrame({"id": np.arange(at, at + n), "vector": list(raw[:, 1:].view(kind))})

    tasks = -(-rows // rows_a_task)
    ranges = spark.range(0, tasks, 1, max(1, tasks)).select((F.col("id") * rows_a_task).alias("at"))
    return ranges.mapInPandas(read, schema)


def read_fvecs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, vector) of float vectors; the path must be visible to driver and executors."""
    return _read_vecs(spark, path, "<f4", limit)


def read_ivecs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _read_vecs(spark, path, "<i4", limit)


def write_fvecs(vectors: DataFrame, path: str, order: str = "id", vector: str = "vector") -> int:
    """Writes the vectors in order of a column, streaming them through the driver part by part; the rows written."""
    n = dim = 0
    beside = path + ".tmp"
    with open(beside, "wb") as f:
        for row in vectors.select(vector).orderBy(order).toLocalIterator() if order in vectors.columns else vectors.select(vector).toLocalIterator():
            v = np.asarray(row[0], "<f4")
            if n and len(v) != dim:
                raise ValueError(f"row {n} has {len(v)} dimensions, not {dim}")
            dim = len(v)
            f.write(struct.pack("<i", dim) + v.tobytes())
            n += 1
    os.replace(beside, path)
    return n


def _sosd_width(path: str) -> int:
    for mark, width in (("uint32", 4), ("uint64", 8)):
        if mark in os.path.basename(path):
            return width
    raise ValueError(f"{path}: the name says neither uint32 nor uint64")


def read_sosd(spark: SparkSession, path: str, keys_a_task: int = 1 << 20) -> DataFrame:
    """The `key` column of a SOSD file, as stored."""
    width, size = _sosd_width(path), os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path} has no count")
    n = struct.unpack("<Q", head)[0]
    if size < 8 + n * width:
        raise ValueError(f"{path} says {n} keys and ends before")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["at"]:
                keys = np.fromfile(path, f"<u{width}", min(keys_a_task, n - at), offset=8 + width * at)
                if width == 8 and len(keys) and keys.max() >= 1 << 63:
                    raise ValueError(f"{path} has keys beyond 2**63")
                yield pd.DataFrame({"key": keys.astype(np.int64)})

    tasks = -(-n // keys_a_task)
    return spark.range(0, tasks, 1, max(1, tasks)).select((F.col("id") * keys_a_task).alias("at")).mapInPandas(read, "key long")


def load_sosd(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(distinct keys in order, with their rank as value; how many repeats were dropped)."""
    keys = read_sosd(spark, path)
    unique = keys.distinct()
    return ranked(unique.orderBy("key"), "key"), keys.count() - unique.count()


def write_sosd(keys, path: str) -> None:
    with open(path, "wb") as f:
        a = np.asarray(keys, f"<u{_sosd_width(path)}")
        f.write(struct.pack("<Q", len(a)) + a.tobytes())


def ranked(df: DataFrame, order: str, name: str = "value") -> DataFrame:
    """df with the 0-based rank of a sort column; nulls come first, rows that tie are ranked in any order.

    The rows are written once, sorted in range partitions, each row with its partition and its place there; the rows a
    partition holds then give every rank. Nothing is partitioned twice, so bounds that are sampled anew, or partitions
    that are merged differently, can't lose a row; ties are parted by a draw, so a hot value is no hot task.
    """
    draw, at, part, before = (f"{x} of {name}" for x in ("draw", "place", "part", "before"))
    rows = df.withColumn(draw, F.rand(17)).repartitionByRange(F.col(f"`{order}`"), F.col(f"`{draw}`")).sortWithinPartitions(f"`{order}`")
    rows = kept(df.sparkSession, rows.drop(draw).withColumn(at, F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn(part, F.shiftright(F.col(f"`{at}`"), 33))  # the lower 33 bits count within the partition
    counts = rows.groupBy(f"`{part}`").agg(F.count("*").alias("n"))
    starts = counts.select(f"`{part}`", (F.sum("n").over(Window.orderBy(f"`{part}`")) - F.col("n")).alias(before))  # a row a partition
    rank = F.col(f"`{before}`") + F.col(f"`{at}`").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), part).select(*(F.col(f"`{c}`") for c in df.columns if c != name), rank.alias(name))


def read_key_csv(spark: SparkSession, path: str, key: str | int, value: str | int, header: bool = True) -> tuple[DataFrame, int]:
    """((key, value) rows of a CSV file, by name or place of the columns; rows that hold no two integers)."""
    raw = spark.read.csv(path, header=header)
    pick = lambda c: F.col(f"`{raw.columns[c] if isinstance(c, int) else c}`")
    both = raw.select(parsed(F.trim(pick(key)), LogicalType.INT64).alias("key"), parsed(F.trim(pick(value)), LogicalType.INT64).alias("value"))
    good = both.filter("key is not null and value is not null")
    return good, both.count() - good.count()


def read_vector_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Vectors of a CSV file of numbers; the order of lines isn't kept, so ids are not dense."""
    raw = spark.read.csv(path, header=header)
    numbers = F.array(*(parsed(F.trim(F.col(f"`{c}`")), LogicalType.DOUBLE).cast("float") for c in raw.columns))
    return raw.select(F.monotonically_increasing_id().alias("id"), numbers.alias("vector"))


def read_npy(spark: SparkSession, path: str, rows_a_task: int = 1 << 16) -> DataFrame:
    """(id, vector) of a two-dimensional .npy array, mapped into memory task by task."""
    shape = np.load(path, mmap_mode="r").shape
    if len(shape) != 2:
        raise ValueError(f"{path} has {len(shape)} dimensions, not 2")
    n = shape[0]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.load(path, mmap_mode="r")
        for batch in batches:
            for at in batch["at"]:
                part = np.asarray(data[at : at + rows_a_task], np.float32)
                yield pd.DataFrame({"id": np.arange(at, at + len(part)), "vector": list(part)})

    tasks = -(-n // rows_a_task)
    return spark.range(0, tasks, 1, max(1, tasks)).select((F.col("id") * rows_a_task).alias("at")).mapInPandas(read, "id long, vector array<float>")


def load_sift(spark: SparkSession, folder: str, name: str = "siftsmall", limit: int | None = None) -> dict[str, DataFrame]:
    """base, query and truth; with a limit on the base the truth is worked out anew for it."""
    from tessera.operators.vectors import ground_truth

    base = read_fvecs(spark, f"{folder}/{name}_base.fvecs", limit)
    query = read_fvecs(spark, f"{folder}/{name}_query.fvecs")
    if limit is None:
        truth = read_ivecs(spark, f"{folder}/{name}_groundtruth.ivecs")
    else:
        truth = ground_truth(base, query, 100)
    return {"base": base, "query": query, "truth": truth}
