"""Which physical layout a column deserves, and the record of that decision.

The kinds keep their names (btree, rmi, dynamic_rmi, bitmap); on Spark a btree is a range-partitioned, sorted table
(row groups are skipped by their least and greatest value), a bitmap a table of bitmaps by value, an rmi a sorted table
with fitted positions (see operators.layouts). Answers never depend on the choice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.types import IndexKind, KeyEncoding, LogicalType, type_is_ordered, type_supports_rmi
from tessera.sources import shared

# The candidates that are offered.
BITMAP_MAX_DISTINCT = 1024
BITMAP_MAX_DENSITY = 0.01
RMI_MODELS = (64, 1024, 16384, 262144)
MERGE_RATIOS = (0.02, 0.05, 0.20)
RETUNE_FACTOR = 1.5


@dataclass(frozen=True)
class ColumnShape:
    rows: int = 0
    distinct: int = 0
    unique: bool = False
    monotone: bool = False
    key_min: int = 0  # marks of the least and the greatest value
    key_max: int = 0

    def duplicate_fraction(self) -> float:
        return 1 - self.distinct / self.rows if self.rows else 0.0


def shape_frame(df: DataFrame, value: str, row: str) -> DataFrame:
    """One row: rows, distinct, is_unique, monotone. monotone: in order of value (and row) the rows ascend.

    That holds if no value's rows reach back behind those of lower values: each value's least row must lie above the
    greatest of the values before it. The values are ranked in range partitions, which meet by their greatest rows only.
    """
    by_value = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi"))
    parts = by_value.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    before = F.max("hi").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    inside = parts.withColumn("fits", F.coalesce(F.col("lo") >= before, F.lit(True)))
    edges = inside.groupBy("p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.count("*").alias("d"), F.min("fits").alias("fits"))
    across = F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    met = edges.withColumn("fits", F.col("fits") & F.coalesce(F.col("lo") >= across, F.lit(True)))
    return met.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("distinct"),
        (F.coalesce(F.sum("n"), F.lit(0)) == F.coalesce(F.sum("d"), F.lit(0))).alias("is_unique"),
        F.coalesce(F.min("fits"), F.lit(True)).alias("monotone"),
    )


def mark(value: Column) -> Column:
    """A whole number that tells a value from others: the value itself, if it is one, else a hash."""
    return F.xxhash64(value)


def measure_shape(df: DataFrame, value: str, row: str) -> ColumnShape:
    kind = dict(df.dtypes)[value]
    of = (lambda v: v.cast("long")) if kind in ("bigint", "int", "smallint", "tinyint") else mark
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.select(*(F.when(F.col(c).isNotNull(), of(F.col(c))).otherwise(0).alias(c) for c in ("lo", "hi"))).first()
    return ColumnShape(*shape_frame(df, value, row).select("rows", "distinct", "is_unique", "monotone").first(), *ends)


@dataclass(frozen=True)
class IndexPlan:
    kind: IndexKind = IndexKind.BTREE
    type: LogicalType = LogicalType.INT64
    encoding: KeyEncoding = KeyEncoding.NATIVE
    rmi_models: int = 1024
    search_threshold: int = 64
    btree_order: int = 32
    merge_ratio: float = 0.05
    ns_per_lookup: float = 0.0
    ns_per_write: float = 0.0
    max_error: int = 0
    index_bytes: int = 0
    write_fraction: float = 0.0
    n_keys: int = 0
    key_min: int = 0
    key_max: int = 0
    distinct: int = 0
    monotone: bool = False

    def serves(self, write_fraction: float) -> bool:
        """A static learned layout takes no writes."""
        return write_fraction <= 0 or self.kind != IndexKind.RMI

    def matches(self, n_keys: int, key_min: int, key_max: int) -> bool:
        return self.n_keys == n_keys and (n_keys == 0 or (self.key_min, self.key_max) == (key_min, key_max))


def candidates_for(kind: LogicalType, shape: ColumnShape, write_fraction: float = 0.0) -> list[IndexPlan]:
    """The layouts that can serve a column at all, in the order in which they are tried."""
    kind, out = LogicalType(kind), []
    few = shape.distinct <= BITMAP_MAX_DISTINCT or (shape.rows and shape.distinct / shape.rows <= BITMAP_MAX_DENSITY)
    if kind == LogicalType.BOOL or (few and kind != LogicalType.VECTOR):
        out.append(IndexPlan(IndexKind.BITMAP, kind, KeyEncoding.DICTIONARY))
    if kind == LogicalType.BOOL:
        return out
    out.append(IndexPlan(IndexKind.BTREE, kind, KeyEncoding.NATIVE if shape.unique else KeyEncoding.COMPOSITE))
    if shape.unique and type_supports_rmi(kind):
        for models in RMI_MODELS:
            if shape.rows and models > shape.rows:
                break
            if write_fraction <= 0:
                out.append(IndexPlan(IndexKind.RMI, kind, KeyEncoding.NATIVE, models))
            else:
                out += [IndexPlan(IndexKind.DYNAMIC_RMI, kind, KeyEncoding.NATIVE, models, merge_ratio=r) for r in MERGE_RATIOS]
    return out


def check_kind(kind: LogicalType, index: IndexKind, unique: bool) -> None:
    """Errors for layouts that can't hold a column."""
    kind, index = LogicalType(kind), IndexKind(index)
    if kind == LogicalType.VECTOR:
        raise ValueError("vectors have an index of their own")
    if not type_is_ordered(kind) and index != IndexKind.BITMAP:
        raise ValueError(f"a {kind.value} column has no order; only a bitmap holds it")
    if index in (IndexKind.RMI, IndexKind.DYNAMIC_RMI) and not type_supports_rmi(kind):
        raise ValueError(f"no model fits {kind.value} keys")
    if index in (IndexKind.RMI, IndexKind.DYNAMIC_RMI) and not unique:
        raise ValueError("a learned layout needs unique keys")


def fingerprinted(plan: IndexPlan, shape: ColumnShape) -> IndexPlan:
    return replace(plan, n_keys=shape.rows, key_min=shape.key_min, key_max=shape.key_max, distinct=shape.distinct, monotone=shape.monotone)


def blended_cost(plan: IndexPlan, write_fraction: float) -> float:
    return (1 - write_fraction) * plan.ns_per_lookup + write_fraction * plan.ns_per_write


def choose(kind: LogicalType, shape: ColumnShape, measure: Callable[[IndexPlan], IndexPlan], size_budget: int | None = None, write_fraction: float = 0.0) -> IndexPlan:
    """The cheapest measured candidate within the budget, the smaller of equals. Where none fits, the sorted layout
    (the first candidate for a bool), unmeasured: it has nothing to trade away."""
    offered = candidates_for(kind, shape, write_fraction)
    measured = [replace(measure(p), write_fraction=write_fraction, distinct=shape.distinct, monotone=shape.monotone) for p in offered]
    fit = [p for p in measured if size_budget is None or p.index_bytes <= size_budget]
    if fit:
        return min(fit, key=lambda p: (blended_cost(p, write_fraction), p.index_bytes))
    plain = next((p for p in offered if p.kind == IndexKind.BTREE), offered[0])
    return replace(plain, n_keys=shape.rows, distinct=shape.distinct, monotone=shape.monotone, write_fraction=write_fraction)


def timed(action: Callable[[], object], runs: int = 3) -> float:
    """Nanoseconds of the fastest run."""
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter_ns()
        action()
        best = min(best, time.perf_counter_ns() - began)
    return best


class IndexCatalog:
    """Decisions by column, kept as JSON: times in whole picoseconds, ratios in thousandths."""

    def __init__(self, retune_factor: float = RETUNE_FACTOR):
        self._plans: dict[str, IndexPlan] = {}
        self.retune_factor = retune_factor

    def set(self, column: str, plan: IndexPlan) -> None:
        self._plans[column] = plan

    def get(self, column: str) -> IndexPlan | None:
        return self._plans.get(column)

    def erase(self, column: str) -> bool:
        return self._plans.pop(column, None) is not None

    def columns(self) -> list[str]:
        return sorted(self._plans)

    def clear(self) -> None:
        self._plans.clear()

    def freshness(self, column: str, shape: ColumnShape) -> str:
        """missing, fresh or stale: a plan holds for as many keys and distinct values, from the same least to the same
        greatest, as it was made for."""
        plan = self._plans.get(column)
        if plan is None:
            return "missing"
        return "fresh" if plan.matches(shape.rows, shape.key_min, shape.key_max) and plan.distinct == shape.distinct else "stale"

    def build_column(self, column: str, kind: LogicalType, shape: ColumnShape, measure: Callable[[IndexPlan], IndexPlan], write_fraction: float = 0.0) -> tuple[IndexPlan, str]:
        """(plan, replayed | retuned | chosen). A fresh plan is taken as it is; a stale one whose layout still fits is
        timed again and stays if it is no slower than retune_factor times before; else the choice is made anew."""
        old = self._plans.get(column)
        if old is not None and old.serves(write_fraction) and self._fits(old, kind, shape):
            if self.freshness(column, shape) == "fresh":
                return old, "replayed"
            again = fingerprinted(replace(measure(old), write_fraction=write_fraction), shape)
            if again.ns_per_lookup <= self.retune_factor * old.ns_per_lookup:
                self._plans[column] = again
                return again, "retuned"
        new = fingerprinted(choose(kind, shape, measure, write_fraction=write_fraction), shape)
        self._plans[column] = new
        return new, "chosen"

    @staticmethod
    def _fits(plan: IndexPlan, kind: LogicalType, shape: ColumnShape) -> bool:
        if plan.type != LogicalType(kind):
            return False
        return shape.unique or plan.kind == IndexKind.BITMAP or plan.encoding == KeyEncoding.COMPOSITE

    def serialize(self) -> str:
        plans = []
        for column in self.columns():
            d = asdict(self._plans[column])
            for f in ("ns_per_lookup", "ns_per_write"):
                d[f.replace("ns_", "ps_")] = round(d.pop(f) * 1000)
            for f in ("merge_ratio", "write_fraction"):
                d[f + "_permille"] = round(d.pop(f) * 1000)
            plans.append({"column": column} | {k: v.value if hasattr(v, "value") else v for k, v in d.items()})
        return json.dumps({"version": 1, "plans": plans})

    @staticmethod
    def parse(blob: str) -> IndexCatalog:
        out = IndexCatalog()
        names = set(IndexPlan.__dataclass_fields__)
        for d in json.loads(blob)["plans"]:
            column = d.pop("column")
            for f in ("ps_per_lookup", "ps_per_write"):
                d[f.replace("ps_", "ns_")] = d.pop(f, 0) / 1000
            for f in ("merge_ratio", "write_fraction"):
                d[f] = d.pop(f + "_permille", 0) / 1000
            d = {k: v for k, v in d.items() if k in names}
            d |= {"kind": IndexKind(d["kind"]), "type": LogicalType(d["type"]), "encoding": KeyEncoding(d["encoding"])}
            out._plans[column] = IndexPlan(**d)
        return out

    def save(self, path: str) -> None:
        shared.atomic_write(path, self.serialize())

    @staticmethod
    def load(path: str) -> IndexCatalog:
        """Empty if there is no file; an error if it is broken."""
        if not shared.exists(path):
            return IndexCatalog()
        blob = shared.read_text(path)
        try:
            return IndexCatalog.parse(blob)
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"the catalog {path} is broken: {e}") from e
