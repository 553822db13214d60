"""Approximate search over cells: a vector lies in the cell of its nearest centre, a query probes the nearest cells.

The vectors of the probed cells are scored exactly, so probing every cell gives the exact answer. `ef`, the effort of a
search, stands for a share of the cells: probes(ef) grows with it and reaches all of them at FULL_EFFORT.
A router may name the cells instead of the distance to their centres.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.types import Metric
from tessera.operators.vectors import BATCH_ROWS, check_query, present_score, rank_score, scores, search, search_batch
from tessera.sources.shared import kept

FULL_EFFORT = 400
EF_SEARCH = 240  # the default; recall of 10 neighbours is above 0.9 on vectors with hardly any clusters
SAMPLE = 100_000
PIECE = 2048  # vectors, and queries, that are scored at once
MOST_CELLS = 16_384  # centres are held by the driver and every executor: 100 MB at 768 dimensions


def kmeans(vectors: DataFrame, clusters: int, seed: int = 0, iterations: int = 25, sample_limit: int = SAMPLE, vector: str = "vector") -> np.ndarray:
    """Centres, fitted on a sample of at most about sample_limit rows; fewer centres than asked for if rows are fewer."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n == 0 or clusters <= 0:
        raise ValueError("no rows or no clusters")
    rows = vectors.sample(fraction=sample_limit / n, seed=seed) if n > sample_limit else vectors
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(clusters, n)), seed=seed, maxIter=iterations).fit(data) if clusters > 1 and n > 1 else None
    if model is None:
        return np.array([rows.select(vector).agg(*(F.avg(F.col(vector)[i]) for i in range(len(rows.first()[vector])))).first()], np.float64)
    return np.array(model.clusterCenters())


def assign(vectors: DataFrame, centres: np.ndarray, vector: str = "vector", name: str = "cell") -> DataFrame:
    """vectors with the number of the nearest centre; ties go to the lower number."""
    known = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    @F.pandas_udf("int")
    def nearest(v):
        import pandas as pd

        c = known.value
        out = []
        for at in range(0, len(v), 4096):
            part = np.stack(v.iloc[at : at + 4096].to_numpy()).astype(np.float64)
            out.append((((part**2).sum(1)[:, None] - 2 * part @ c.T) + (c**2).sum(1)[None, :]).argmin(axis=1))
        return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="int32")

    return vectors.withColumn(name, nearest(F.col(vector)))


def medoids(assigned: DataFrame, centres: np.ndarray, row: str = "id", vector: str = "vector", cell: str = "cell") -> DataFrame:
    """(cell, medoid, distance): the row nearest to each centre, the lower one of a tie."""
    spark = assigned.sparkSession
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(np.asarray(centres, np.float64))], f"{cell} int, __c array<double>")
    scored = assigned.join(F.broadcast(table), cell).withColumn("__d", rank_score(vector, F.col("__c"), Metric.L2))
    return scored.groupBy(cell).agg(F.min(F.struct("__d", row)).alias("m")).select(cell, F.col(f"m.{row}").alias("medoid"), F.sqrt("m.__d").alias("distance"))


class CentroidRouter:
    """Cells by the distance of their centres."""

    def __init__(self, centres: np.ndarray):
        self.centres = np.asarray(centres, np.float64)

    def to_json(self) -> str:
        return json.dumps({"kind": "centroid", "dim": self.centres.shape[1], "centres": self.centres.tolist()})

    @staticmethod
    def from_json(text: str) -> CentroidRouter:
        return CentroidRouter(np.array(json.loads(text)["centres"], np.float64))

    def require_compatible(self, dim: int, cells: int) -> None:
        if self.centres.shape != (cells, dim):
            raise ValueError(f"the router is for {self.centres.shape[0]} cells of {self.centres.shape[1]} dimensions, not {cells} of {dim}")

    def predict(self, query, p: int) -> list[int]:
        d = ((self.centres - np.asarray(query, np.float64)) ** 2).sum(axis=1)
        return np.lexsort((np.arange(len(d)), d))[:p].tolist()


@dataclass
class RouterMLP:
    """One hidden layer of rectified units over standardised queries; logits of the cells."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, cells: int, hidden: int = 64, epochs: int = 60, rate: float = 1e-3, batch: int = 256, seed: int = 0) -> RouterMLP:
        """Softmax cross-entropy by Adam; the standardisation is folded into the first layer at the end."""
        rng = np.random.default_rng(seed)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8)
        z = (x - mean) / scale
        params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, cells)), np.zeros(cells)]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                rows = order[at : at + batch]
                grads, t = RouterMLP.gradients(params, z[rows], labels[rows]), t + 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        w1 = params[0] / scale[:, None]
        return RouterMLP(w1, params[1] - mean @ w1, params[2], params[3])

    @staticmethod
    def gradients(params, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = params
        h = x @ w1 + b1
        a = np.maximum(h, 0)
        p = softmax(a @ w2 + b2)
        p[np.arange(len(x)), labels] -= 1
        p /= len(x)
        back = (p @ w2.T) * (h > 0)
        return [x.T @ back, back.sum(axis=0), a.T @ p, p.sum(axis=0)]

    def logits(self, query) -> np.ndarray:
        return np.maximum(np.asarray(query, np.float64) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def predict(self, query, p: int) -> list[int]:
        s = self.logits(query)
        return np.lexsort((np.arange(len(s)), -s))[:p].tolist()

    def to_json(self, medoids: dict[int, int] | None = None, baseline: float | None = None) -> str:
        """The network, with the row nearest to each centre and the entry distance it was set at, if these are given."""
        dim, cells = self.w1.shape[0], self.w2.shape[1]
        kept = {"kind": "mlp", "dim": dim, "cells": cells, "medoids": sorted((medoids or {}).items()), "baseline": baseline}
        return json.dumps(kept | {k: getattr(self, k).tolist() for k in ("w1", "b1", "w2", "b2")})

    @staticmethod
    def from_json(text: str) -> RouterMLP:
        d = json.loads(text)
        return RouterMLP(*(np.array(d[k], np.float64) for k in ("w1", "b1", "w2", "b2")))

    def require_compatible(self, dim: int, cells: int) -> None:
        have = (self.w1.shape[0], self.w2.shape[1])
        if have != (dim, cells):
            raise ValueError(f"the router is for {have[1]} cells of {have[0]} dimensions, not {cells} of {dim}")


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training_set(assigned: DataFrame, n: int, jitter: float = 0.05, seed: int = 0, row: str = "id", vector: str = "vector", cell: str = "cell") -> tuple[np.ndarray, np.ndarray]:
    """(queries, cells of their true nearest neighbours): n sampled vectors, each moved a little."""
    sample = assigned.select(row, vector).orderBy(F.rand(seed), row).limit(n)
    x = np.array([r[vector] for r in sample.collect()], np.float64)  # n rows
    x = x + np.random.default_rng(seed).normal(0, jitter, x.shape)
    queries = assigned.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = search_batch(assigned, queries, 1, row=row, vector=vector).join(assigned.select(row, cell), row)
    labels = dict(found.select("qid", cell).collect())
    return x, np.array([labels[i] for i in range(len(x))])


def ordered_cells(centres: np.ndarray, router, top_p: int, query) -> list[int]:
    """All cells, those that the router names first, the others by the distance of their centres."""
    ranked = CentroidRouter(centres).predict(query, len(centres))
    routed = router.predict(query, max(top_p, 1)) if router is not None else []
    return routed + [c for c in ranked if c not in routed]


class CellIndex:
    """Approximate index; its cells are a column, so a search reads the probed cells only where files are laid out by it."""

    def __init__(self, spark: SparkSession, vectors: DataFrame, dim: int, metric: Metric = Metric.L2, cells: int | None = None, seed: int = 100, row: str = "id", vector: str = "vector", centres: np.ndarray | None = None):
        """centres: given ones, instead of those that k-means finds. The rows are written once, by cell, so that a search
        reads the files of the cells it probes."""
        self.spark, self.dim, self.metric, self.row, self.vector = spark, dim, Metric(metric), row, vector
        n = vectors.count()
        if centres is None:
            centres = kmeans(vectors, min(cells or max(1, round(n**0.5 / 2)), MOST_CELLS), seed, vector=vector) if n else np.zeros((0, dim))
        self.centres = np.asarray(centres, np.float64)
        placed = assign(vectors, self.centres, vector) if n else vectors.withColumn("cell", F.lit(0))
        self.frame = kept(spark, placed.repartitionByRange("cell", row).sortWithinPartitions("cell", row), "cells")
        self.size, self.router, self.router_top_p, self.baseline = n, None, 2, None
        self.last_probed = 0

    def probes(self, ef: int = 0) -> int:
        return min(len(self.centres), max(1, -(-len(self.centres) * (ef or EF_SEARCH) // FULL_EFFORT)))

    def _cells(self, query, ef: int) -> list[int]:
        return ordered_cells(self.centres, self.router, self.router_top_p, query)[: self.probes(ef)]

    def search(self, query, k: int, ef: int = 0, allowed: DataFrame | None = None) -> DataFrame:
        """k nearest among the probed cells. With `allowed` (a frame of rows) more cells are probed until k are found."""
        check_query(query, self.dim)
        rows = self.frame if allowed is None else self.frame.join(allowed.select(F.col(allowed.columns[0]).alias(self.row)).distinct(), self.row, "left_semi")
        ranked, n = self._cells(query, FULL_EFFORT), self.probes(max(ef or EF_SEARCH, k))
        if allowed is not None and n < len(ranked):
            held = dict(rows.groupBy("cell").count().collect())  # a number a cell
            while n < len(ranked) and sum(held.get(c, 0) for c in ranked[:n]) < k:
                n += 1
        self.last_probed = n
        probed = rows.filter(F.col("cell").isin(ranked[:n])) if n < len(ranked) else rows
        return search(probed.drop("cell"), query, k, self.metric, self.row, self.vector)

    def search_batch(self, queries: DataFrame, k: int, ef: int = 0, query_row: str = "id", query_vector: str = "vector") -> DataFrame:
        """(qid, row, score, rank): each cell's vectors, dealt into pieces of bounded size, meet the queries that probe it.

        A piece and a block of its queries are scored as one matrix product, and only the k best rows of every query are
        handed on; nothing is emitted for each pair.
        """
        n, known, metric, row = self.probes(max(ef or EF_SEARCH, k)), self.spark.sparkContext.broadcast(self.centres), self.metric, self.row
        router, top_p = self.router, self.router_top_p

        @F.pandas_udf("array<int>")
        def near(v):
            import pandas as pd

            c, out = known.value, []
            for at in range(0, len(v), BATCH_ROWS):
                q = np.stack(v.iloc[at : at + BATCH_ROWS].to_numpy()).astype(np.float64)
                if router is not None:
                    out += [np.array(ordered_cells(c, router, top_p, x)[:n], np.int32) for x in q]
                    continue
                d = (c**2).sum(axis=1)[None, :] - 2 * q @ c.T  # the query's own square is the same for all
                out += list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32))
            return pd.Series(out)

        probes = queries.select(F.col(query_row).alias("qid"), F.col(query_vector).alias("q"), F.explode(near(F.col(query_vector))).alias("cell"))
        pieces = self.frame.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
        blocks = probes.groupBy("cell").count().select("cell", F.ceil(F.col("count") / PIECE).cast("int").alias("blocks"))
        sizes = F.broadcast(pieces.join(blocks, "cell"))  # MOST_CELLS rows
        spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        dealt = lambda own, count: F.pmod(F.xxhash64(own), F.col(count)).cast("int")
        v = self.frame.join(sizes, "cell").select("cell", dealt(row, "pieces").alias("i"), spread("blocks").alias("j"), F.col(row).cast("long").alias("id"), F.col(self.vector).cast("array<float>").alias("v"), F.lit(False).alias("asks"))
        q = probes.join(sizes, "cell").select("cell", spread("pieces").alias("i"), dealt("qid", "blocks").alias("j"), F.col("qid").cast("long").alias("id"), F.col("q").cast("array<float>").alias("v"), F.lit(True).alias("asks"))

        def best(group):
            import pandas as pd

            asks = group["asks"].to_numpy()
            if asks.all() or not asks.any():
                return pd.DataFrame({"qid": [], row: [], "__s": []}).astype({"qid": "int64", row: "int64", "__s": "float64"})
            data, ids = np.stack(group["v"].to_numpy()).astype(np.float64), group["id"].to_numpy()
            order = np.argsort(ids[~asks])
            rows, vectors = ids[~asks][order], data[~asks][order]
            s = scores(vectors, data[asks], metric, k)
            return pd.DataFrame({"qid": np.repeat(ids[asks], len(s[0])), row: rows[s[0]].T.ravel(), "__s": s[1].T.ravel()})

        found = v.unionByName(q).groupBy("cell", "i", "j").applyInPandas(best, f"qid long, {row} long, __s double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("__s", row))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", row, present_score(F.col("__s"), metric).alias("score"), "rank")

    def stats(self) -> dict:
        """Cells and the least, mean and most vectors in one."""
        r = self.frame.groupBy("cell").count().agg(F.count("*"), F.min("count"), F.avg("count"), F.max("count")).first()
        return {"nodes": self.size, "cells": r[0], "least": r[1], "mean": r[2], "most": r[3]}

    def set_router(self, router, top_p: int = 2) -> None:
        router.require_compatible(self.dim, len(self.centres))
        self.router, self.router_top_p = router, top_p
        self.rebaseline_router()

    def clear_router(self) -> None:
        self.router = self.baseline = None

    def _entry_distance(self, sample: int, seed: int) -> float:
        rows = self.frame.select(self.row, self.vector).orderBy(F.rand(seed), self.row).limit(sample).collect()
        d = [float(np.sqrt(((self.centres[self._cells(r[self.vector], 1)[0]] - np.array(r[self.vector])) ** 2).sum())) for r in rows]
        return float(np.mean(d)) if d else 0.0

    def rebaseline_router(self, sample: int = 2000, seed: int = 0) -> float:
        self.baseline = self._entry_distance(sample, seed)
        return self.baseline

    def router_health(self, sample: int = 2000, seed: int = 0) -> float:
        """Mean distance from a vector to the entry it is routed to, over the baseline: 1 is as good as when it was set."""
        return self._entry_distance(sample, seed) / self.baseline if self.baseline else 1.0

    def repair_router_medoids(self) -> DataFrame:
        """Elects each cell's medoid anew."""
        return medoids(self.frame, self.centres, self.row, self.vector)


class LshIndex:
    """Random projections into buckets, the independent baseline of the cells. Euclidean only."""

    def __init__(self, vectors: DataFrame, tables: int = 8, bucket_length: float = 1.0, seed: int = 100, row: str = "id", vector: str = "vector"):
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        self.row = row
        self.frame = vectors.select(row, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        self.model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket_length, seed=seed).fit(self.frame)

    def search(self, query, k: int) -> DataFrame:
        """(row, score) of about k nearest; fewer if their buckets hold fewer."""
        from pyspark.ml.linalg import Vectors

        found = self.model.approxNearestNeighbors(self.frame, Vectors.dense([float(x) for x in query]), k, distCol="score")
        return found.select(self.row, "score").orderBy("score", self.row)
