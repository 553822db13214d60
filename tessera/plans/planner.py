"""Which plan answers "the k nearest among the rows that satisfy a predicate", and the plans themselves.

The decision rests on the exact number of matching rows. It is taken above Catalyst, by choosing which frame to build:

    pre_filter             score the matching rows exactly
    filtered_graph         probe cells of the approximate index, matching rows only
    bitmap_filtered_graph  the same, where bitmaps have answered the predicate
    post_filter            take 10 k nearest of all rows, then filter: may give fewer than k
    no_predicate           nearest of all rows
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import Predicate, PredOp, all_of
from tessera.functions.schema import ColumnDef, Schema
from tessera.functions.types import LogicalType, Metric, PlanKind
from tessera.operators.ann import CellIndex
from tessera.operators.vectors import search

OVERFETCH = 10
PREFILTER_THRESHOLD = 0.5


@dataclass
class QueryPlan:
    kind: PlanKind = PlanKind.PRE_FILTER
    matched_rows: int = 0
    corpus_rows: int = 0
    selectivity: float = 0.0
    threshold: float = PREFILTER_THRESHOLD
    selectivity_was_free: bool = False
    reason: str = ""


class QueryTrace:
    """How a query was answered: why, by a layout or not, how many rows were tested one by one, how many matched. The
    numbers may be given as functions: they are counted when they are asked for, and once."""

    def __init__(self, reason: str = "", used_index: bool = False, scanned: int | Callable[[], int] = 0, matched: int | Callable[[], int] = 0):
        self.reason, self.used_index, self._scanned, self._matched = reason, used_index, scanned, matched

    @property
    def scanned(self) -> int:
        self._scanned = self._scanned() if callable(self._scanned) else self._scanned
        return self._scanned

    @property
    def matched(self) -> int:
        self._matched = self._matched() if callable(self._matched) else self._matched
        return self._matched


@dataclass
class HybridTrace:
    structured: QueryTrace = field(default_factory=QueryTrace)
    plan: QueryPlan = field(default_factory=QueryPlan)
    without_vector: int = 0
    mask_used: bool = False


def decide(matched: int, corpus: int, k: int, threshold: float, has_graph: bool, has_mask: bool = False) -> QueryPlan:
    """The rule. Exact scoring where nothing or little matches, where no approximate index is, or where all matches
    are wanted anyway; a selectivity equal to the threshold still counts as little."""
    share = matched / corpus if corpus else 0.0
    said = f"{share:.2%} of {corpus} rows match, threshold {threshold:.2%}"
    exact = {
        "nothing matches": matched == 0,
        "there is no approximate index": not has_graph,
        f"{matched} matches are no more than k = {k}": matched <= k,
        said: share <= threshold,
    }
    for reason, holds in exact.items():
        if holds:
            return QueryPlan(PlanKind.PRE_FILTER, matched, corpus, share, threshold, has_mask, reason)
    kind = PlanKind.BITMAP_FILTERED_GRAPH if has_mask else PlanKind.FILTERED_GRAPH
    return QueryPlan(kind, matched, corpus, share, threshold, has_mask, said)


def execute(kind: PlanKind, vectors: DataFrame, query, k: int, ef: int, metric: Metric, allowed: DataFrame | None, graph: CellIndex | None, row: str = "id", vector: str = "vector") -> DataFrame:
    """Runs a plan over vectors (row, vector); allowed: the matching rows (None with no_predicate)."""
    kind = PlanKind(kind)
    if kind in (PlanKind.FILTERED_GRAPH, PlanKind.BITMAP_FILTERED_GRAPH):
        if graph is None:
            raise ValueError(f"{kind.value} needs an approximate index")
        return graph.search(query, k, ef, allowed)
    if kind == PlanKind.NO_PREDICATE:
        return graph.search(query, k, ef) if graph is not None else search(vectors, query, k, metric, row, vector)
    ids = allowed.select(F.col(allowed.columns[0]).alias(row)).distinct()
    if kind == PlanKind.PRE_FILTER:
        return search(vectors.join(ids, row, "left_semi"), query, k, metric, row, vector)
    wide = k * OVERFETCH
    near = graph.search(query, wide, ef) if graph is not None else search(vectors, query, wide, metric, row, vector)
    order = F.col("score") if Metric(metric) == Metric.L2 else -F.col("score")
    return near.join(ids, row, "left_semi").orderBy(order, row).limit(k)


def crossover(points: list[tuple[float, float, float]], unchanged: float) -> float:
    """points: (selectivity, seconds of the scan, seconds of the index), ascending. Half way between the last win of
    the scan and the first of the index; the old threshold if the index never wins."""
    scan_wins = [s for s, scan, graph in points if scan <= graph]
    graph_wins = [s for s, scan, graph in points if scan > graph]
    return 0.5 * ((max(scan_wins) if scan_wins else 0.0) + min(graph_wins)) if graph_wins else unchanged


def calibrate(vectors: DataFrame, graph: CellIndex | None, queries, k: int, ef: int, samples: int, metric: Metric, unchanged: float, row: str = "id", vector: str = "vector") -> float:
    """Times exact and approximate search on growing shares of the rows (the best of three runs each)."""
    if graph is None or not len(queries) or samples < 2:
        return unchanged
    n = vectors.count()
    ordered = vectors.select(row).orderBy(row)
    points = []
    for s in range(1, samples + 1):
        take = int(s / samples * n)
        if take <= k:
            continue
        allowed = ordered.limit(take)

        def timed(kind, allowed=allowed):
            best = float("inf")
            for _ in range(3):
                began = time.perf_counter()
                for q in queries:
                    execute(kind, vectors, q, k, ef, metric, allowed, graph, row, vector).collect()
                best = min(best, time.perf_counter() - began)
            return best

        points.append((s / samples, timed(PlanKind.PRE_FILTER), timed(PlanKind.FILTERED_GRAPH)))
    return crossover(points, unchanged)


class HybridPlanner:
    """The planner over a frame of (row, attributes) and a frame of (row, vector), without a store."""

    def __init__(self, vectors: DataFrame, metric: Metric = Metric.L2, prefilter_threshold: float = PREFILTER_THRESHOLD, row: str = "id", vector: str = "vector"):
        self.vectors, self.metric, self.prefilter_threshold, self.row, self.vector = vectors, Metric(metric), prefilter_threshold, row, vector
        self.schema, self.attributes, self.masks, self.graph = Schema(), None, set(), None
        self._corpus: int | None = None

    def set_column(self, name: str, frame: DataFrame, kind: LogicalType, bitmap: bool = False) -> None:
        """frame: (row, value) of an attribute; bitmap: its predicates count as answered by bitmaps."""
        if not self.schema.has(name):
            self.schema.add(ColumnDef(name, LogicalType(kind)))
        part = frame.select(F.col(frame.columns[0]).alias(self.row), F.col(frame.columns[1]).alias(name))
        self.attributes = part if self.attributes is None else self.attributes.drop(name).join(part, self.row, "full")
        self.masks.discard(name)
        if bitmap:
            self.masks.add(name)

    def set_graph(self, graph: CellIndex | None) -> None:
        self.graph = graph

    def has_column(self, name: str) -> bool:
        return self.schema.has(name)

    def columns(self) -> list[str]:
        return [c.name for c in self.schema.columns()]

    def corpus_size(self) -> int:
        if self._corpus is None:
            self._corpus = self.vectors.count()
        return self._corpus

    def matching_rows(self, predicate) -> DataFrame:
        p = Predicate.of(predicate)
        if p.op in (PredOp.CONTAINS, PredOp.IS_NULL):
            raise ValueError(f"{p.op.value!r} has no index to answer it")
        return self.attributes.filter(p.compile(self.schema)).select(self.row)

    def _masked(self, predicate) -> bool:
        return Predicate.of(predicate).column in self.masks

    def explain(self, predicate, k: int = 10) -> QueryPlan:
        return self.explain_rows(self.matching_rows(predicate), k, self._masked(predicate))

    def explain_rows(self, rows: DataFrame, k: int = 10, mask: bool = False) -> QueryPlan:
        return decide(rows.distinct().count(), self.corpus_size(), k, self.prefilter_threshold, self.graph is not None, mask)

    def search(self, predicate, query, k: int = 10, ef: int = 0) -> tuple[DataFrame, QueryPlan]:
        rows = self.matching_rows(predicate)
        plan = self.explain_rows(rows, k, self._masked(predicate))
        return self._run(plan.kind, rows, query, k, ef), plan

    def search_with(self, kind: PlanKind, predicate, query, k: int = 10, ef: int = 0) -> DataFrame:
        if not self.plan_available(kind, predicate):
            raise ValueError(f"{PlanKind(kind).value} is not available here")
        return self._run(kind, self.matching_rows(predicate), query, k, ef)

    def search_rows(self, rows: DataFrame, query, k: int = 10, ef: int = 0, mask: bool = False) -> tuple[DataFrame, QueryPlan]:
        plan = self.explain_rows(rows, k, mask)
        return self._run(plan.kind, rows, query, k, ef), plan

    def search_mask(self, predicates, query, k: int = 10, ef: int = 0) -> tuple[DataFrame, QueryPlan]:
        """Rows for which all predicates hold, as one filter."""
        rows = self.attributes.filter(all_of(predicates, self.schema)).select(self.row)
        return self.search_rows(rows, query, k, ef, mask=True)

    def _run(self, kind, rows, query, k, ef):
        return execute(kind, self.vectors, query, k, ef, self.metric, rows, self.graph, self.row, self.vector)

    def plan_available(self, kind: PlanKind, predicate) -> bool:
        kind = PlanKind(kind)
        if kind == PlanKind.FILTERED_GRAPH:
            return self.graph is not None
        if kind == PlanKind.BITMAP_FILTERED_GRAPH:
            return self.graph is not None and self._masked(predicate)
        return kind in (PlanKind.PRE_FILTER, PlanKind.POST_FILTER)

    def calibrate(self, queries, k: int = 10, ef: int = 0, samples: int = 12) -> float:
        self.prefilter_threshold = calibrate(self.vectors, self.graph, queries, k, ef, samples, self.metric, self.prefilter_threshold, self.row, self.vector)
        return self.prefilter_threshold
