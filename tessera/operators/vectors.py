"""Exact nearest-neighbour search: three metrics, filters, batches, recall.

Scores are in double precision. Distances under L2 are compared as squares and rooted only for the rows that are
returned. Larger is better for inner product and cosine, and results are always best first; equal scores go to the
lower row. A zero vector has the cosine 0 to everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import Metric
from tessera.sources.files import ranked

BATCH_ROWS = 4096


def _array(query) -> Column:
    return query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in np.asarray(query, np.float32)))


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def rank_score(vector, query, metric: Metric) -> Column:
    """What rows are ordered by, ascending."""
    v, q, metric = F.col(vector) if isinstance(vector, str) else vector, _array(query), Metric(metric)
    if metric == Metric.L2:
        return _sum(v, q, lambda x, y: (x - y) * (x - y))
    dot = _sum(v, q, lambda x, y: x * y)
    if metric == Metric.INNER_PRODUCT:
        return -dot
    norms = F.sqrt(_sum(v, v, lambda x, y: x * y)) * F.sqrt(_sum(q, q, lambda x, y: x * y))
    return -F.coalesce(F.try_divide(dot, norms), F.lit(0.0))


def present_score(rank: Column, metric: Metric) -> Column:
    return F.sqrt(rank) if Metric(metric) == Metric.L2 else -rank


def normalised(vector) -> Column:
    """The vector over its length; a zero vector as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(_sum(v, v, lambda x, y: x * y))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def check_query(query, dim: int) -> None:
    if np.asarray(query).shape != (dim,):
        raise ValueError(f"the query has the shape {np.asarray(query).shape}, the vectors {dim} dimensions")


def search(vectors: DataFrame, query, k: int, metric: Metric = Metric.L2, row: str = "id", vector: str = "vector") -> DataFrame:
    """The k best rows with their `score`: one pass, each task keeps its k best (TakeOrderedAndProject)."""
    if k <= 0:
        return vectors.limit(0).drop(vector).withColumn("score", F.lit(0.0))
    best = vectors.withColumn("__rank", rank_score(vector, query, metric)).orderBy("__rank", row).limit(k)
    return best.withColumn("score", present_score(F.col("__rank"), metric)).drop("__rank", vector)


def search_filtered(vectors: DataFrame, query, k: int, allowed: DataFrame, metric: Metric = Metric.L2, row: str = "id", vector: str = "vector", strict: bool = True) -> DataFrame:
    """search among the rows of `allowed` (its first column); strict: a row that isn't there is an error."""
    ids = allowed.select(F.col(allowed.columns[0]).alias(row)).distinct()
    if strict and (missing := ids.join(vectors.select(row), row, "left_anti").limit(1).collect()):
        raise ValueError(f"there is no row {missing[0][0]}")
    return search(vectors.join(ids, row, "left_semi"), query, k, metric, row, vector)


def search_masked(vectors: DataFrame, query, k: int, mask: Column, metric: Metric = Metric.L2, row: str = "id", vector: str = "vector") -> DataFrame:
    """search among the rows for which a condition holds, in the same scan."""
    return search(vectors.filter(mask), query, k, metric, row, vector)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.L2, row: str = "id", vector: str = "vector", query_row: str = "id", query_vector: str = "vector", block: int = 1024) -> DataFrame:
    """(qid, <row>, score, rank) of the k best rows of every query.

    Queries are dealt into blocks of about `block`, vectors into as many stretches as tasks; each stretch meets each block
    once. The vectors of a stretch are scored against a block as matrix products, and only its k best of every query are
    handed on. Neither queries nor vectors come to the driver, and no pair is emitted.
    """
    spark, metric = vectors.sparkSession, Metric(metric)
    if k <= 0:
        return spark.createDataFrame([], f"qid long, {row} long, score double, rank int")
    kind = "array<double>" if "array<double>" in (dict(queries.dtypes)[query_vector], dict(vectors.dtypes)[vector]) else "array<float>"
    asked = queries.select(F.col(query_row).cast("long").alias("id"), F.col(query_vector).cast(kind).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    stretches = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    there = vectors.select(F.col(row).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    v = there.select(dealt(stretches).alias("i"), spread(blocks).alias("j"), F.lit(1).alias("part"), "id", "v")
    q = asked.select(spread(stretches).alias("i"), dealt(blocks).alias("j"), F.lit(0).alias("part"), "id", "v")
    met = v.unionByName(q).repartition(stretches * blocks, "i", "j").sortWithinPartitions("i", "j", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one stretch and block: the queries first, then the vectors, batch by batch."""
        at, ids, asks, rows, best = None, None, None, None, None

        def done():
            if at is not None and rows is not None and len(ids):
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, n)), pa.array(rows.ravel()), pa.array(best.ravel())], ["qid", row, "__s"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                i, j, part = keys[s].tolist()
                if (i, j) != at:
                    yield from done()
                    at, ids, asks, rows, best = (i, j), np.zeros(0, np.int64), None, None, None
                own, data = batch.column(3).to_numpy()[s:e], _matrix(batch.column(4).slice(s, e - s))
                if part == 0:
                    ids, asks = np.concatenate([ids, own]), data if asks is None else np.concatenate([asks, data])
                elif len(ids):
                    for a in range(0, e - s, BATCH_ROWS):
                        order = np.argsort(own[a : a + BATCH_ROWS])
                        some = own[a : a + BATCH_ROWS][order]
                        place, score = scores(data[a : a + BATCH_ROWS][order], asks, metric, k)
                        new = some[place]
                        if rows is not None:
                            new, score = np.concatenate([rows, new]), np.concatenate([best, score])
                            order = np.lexsort((new, score), axis=0)[:k]
                            new, score = np.take_along_axis(new, order, axis=0), np.take_along_axis(score, order, axis=0)
                        rows, best = new, score
        yield from done()

    found = met.mapInArrow(run, f"qid long, {row} long, __s double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("__s", row))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", row, present_score(F.col("__s"), metric).alias("score"), "rank")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def scores(v: np.ndarray, q: np.ndarray, metric: Metric, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in v, ascending scores) of the k best rows for every query, as columns; equal scores go to the earlier row.

    Candidates come from a matrix product. Under L2 the expanded square cancels for near vectors, so every row whose
    product could still belong to the k best, given how far rounding reaches, is scored again by its differences.
    """
    if metric == Metric.L2:
        vv, qq = (v * v).sum(axis=1), (q * q).sum(axis=1)
        rough = vv[:, None] - 2 * (v @ q.T)  # without the query's own square
        return _exact(v, q, rough, (vv.max(initial=0) + qq) * 1e-12, k)
    dot = v @ q.T
    if metric == Metric.COSINE:
        norms = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        dot = np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)
    order = np.argsort(-dot, axis=0, kind="stable")[:k]
    return order, np.take_along_axis(-dot, order, axis=0)


def _exact(v: np.ndarray, q: np.ndarray, rough: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = rough.shape
    k = min(k, n)
    limit = np.partition(rough, k - 1, axis=0)[k - 1] + 2 * slack if n else np.zeros(m)
    near = rough <= limit
    places, best = np.zeros((k, m), np.int64), np.zeros((k, m))
    wide = int(near.sum(axis=0).max(initial=0))
    order = np.argpartition(rough, min(wide, n) - 1, axis=0)[:wide] if wide < n else np.broadcast_to(np.arange(n)[:, None], (n, m))
    order = np.sort(order, axis=0)
    step = max(1, (1 << 22) // max(1, len(order) * v.shape[1]))  # queries at a time: 32 MB of differences
    for a in range(0, m, step):
        some = order[:, a : a + step]
        d = ((v[some] - q[None, a : a + step]) ** 2).sum(axis=2)
        first = np.argsort(d, axis=0, kind="stable")[:k]
        places[:, a : a + step], best[:, a : a + step] = np.take_along_axis(some, first, axis=0), np.take_along_axis(d, first, axis=0)
    return places, best


def ground_truth(base: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.L2) -> DataFrame:
    """(id, vector) of each query with the ids of its k nearest, best first."""
    found = search_batch(base, queries, k, metric)
    return found.groupBy(F.col("qid").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("vector"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Mean share of the truth that was found; both (qid, id, rank)."""
    t = truth.filter(F.col("rank") <= k).select("qid", "id").distinct()
    f = found.filter(F.col("rank") <= k).select("qid", "id").distinct()
    hits = t.join(f, ["qid", "id"], "left_semi").count()
    n = t.select("qid").distinct().count()
    return hits / (n * k) if n and k > 0 else 0.0


class FlatIndex:
    """Vectors under ascending rows, searched exactly."""

    def __init__(self, spark, dim: int, metric: Metric = Metric.L2):
        if dim <= 0:
            raise ValueError("an index needs a dimension")
        self.spark, self.dim, self.metric = spark, dim, Metric(metric)
        self.clear()

    def clear(self) -> None:
        self.frame, self._size = self.spark.createDataFrame([], "id long, vector array<float>"), 0

    def __len__(self) -> int:
        return self._size

    def reserve(self, rows: int) -> None:
        """Space needs no reserving here."""

    def add(self, vector) -> int:
        return self.add_batch([vector])[0]

    def add_batch(self, rows) -> range:
        """Rows of a matrix (small; add_frame is for large ones); their row numbers."""
        data = np.asarray(rows, np.float32)
        if data.ndim != 2 or data.shape[1] != self.dim:
            raise ValueError(f"vectors of {self.dim} dimensions are wanted, not of the shape {data.shape}")
        new = self.spark.createDataFrame([(self._size + i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<float>")
        return self._append(new, len(data))

    def add_frame(self, vectors: DataFrame, order: str, vector: str = "vector") -> range:
        wrong = vectors.filter((F.size(vector) != self.dim) | F.col(vector).isNull()).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of {self.dim} dimensions are wanted")
        new = ranked(vectors.select(F.col(order).alias("__o"), F.col(vector).alias("vector")), "__o", "__r").select((F.col("__r") + self._size).alias("id"), "vector")
        return self._append(new, new.count())

    def _append(self, new: DataFrame, n: int) -> range:
        if self.metric == Metric.COSINE:
            new = new.withColumn("vector", normalised("vector"))
        self.frame = self.frame.unionByName(new)
        at, self._size = self._size, self._size + n
        return range(at, self._size)

    def search(self, query, k: int) -> DataFrame:
        check_query(query, self.dim)
        return search(self.frame, query, k, self.metric)

    def search_filtered(self, query, k: int, allowed: DataFrame) -> DataFrame:
        check_query(query, self.dim)
        return search_filtered(self.frame, query, k, allowed, self.metric)

    def search_masked(self, query, k: int, mask: Column) -> DataFrame:
        check_query(query, self.dim)
        return search_masked(self.frame, query, k, mask, self.metric)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        return search_batch(self.frame, queries, k, self.metric)

    def vector_at(self, row: int) -> np.ndarray:
        found = self.frame.filter(F.col("id") == row).first()
        if found is None:
            raise IndexError(row)
        return np.array(found["vector"], np.float32)
