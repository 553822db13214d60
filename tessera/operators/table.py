"""Typed tables over a record store: predicates, writes, vector columns, hybrid queries, and a report with every answer.

Reads are Spark plans over the typed columns of the store's snapshot, with the log's later entries laid over it, so
that predicates and column lists reach the scan. A column may have a layout of its own (operators.layouts): it answers
keys and counts without the records, and the records of a few keys are then read by key. Layouts never change an answer,
and reports say what was read. Results come in key order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import Predicate, all_of, any_of, op_is_indexable
from tessera.functions.schema import ColumnDef, Record, Schema
from tessera.functions.types import IndexKind, KeyEncoding, LogicalType, Metric, PlanKind, VectorStructure
from tessera.operators import bitmaps
from tessera.operators.ann import EF_SEARCH, CellIndex
from tessera.operators.layouts import KEY, LEARNED, Layout, measured
from tessera.operators.vectors import check_query, normalised, search
from tessera.plans import planner as P
from tessera.plans.catalog import ColumnShape, IndexCatalog, IndexPlan, check_kind, fingerprinted, measure_shape
from tessera.sources import shared
from tessera.sources.files import ranked, write_fvecs
from tessera.sources.store import RecordStore


@dataclass(frozen=True)
class VectorPlan:
    structure: VectorStructure = VectorStructure.EXACT
    metric: Metric = Metric.L2
    cells: int | None = None
    ef_search: int = EF_SEARCH
    seed: int = 100


@dataclass
class ColumnInfo:
    name: str
    type: LogicalType
    indexed: bool
    rows: int
    skipped: int
    distinct: int
    unique: bool
    monotone: bool
    dirty: bool
    kind: IndexKind | None = None
    encoding: KeyEncoding | None = None
    index_bytes: int = 0
    ns_per_lookup: float = 0.0


@dataclass
class VectorInfo:
    name: str
    dim: int
    indexed: bool
    rows: int
    orphans: int
    structure: VectorStructure
    metric: Metric
    has_graph: bool
    rows_are_keys: bool
    memory_bytes: int


@dataclass
class WriteResult:
    created: bool = False
    rows_written: int = 0
    rows_created: int = 0
    indexes_touched: int = 0
    rebuilds_triggered: int = 0


class VectorColumn:
    """(_key, _vrow, embedding, live): _vrow is the place of insertion; a replaced or erased vector stays as an orphan."""

    STEPS = 16  # changes that a plan may carry before the rows are written anew

    def __init__(self, spark, definition: ColumnDef, plan: VectorPlan = VectorPlan()):
        self.spark, self.definition, self.plan = spark, definition, plan
        self.frame = spark.createDataFrame([], f"{KEY} long, _vrow long, embedding array<float>, live boolean")
        self.next_row, self.indexed, self.graph, self._stale, self._steps = 0, False, None, True, 0

    def live(self) -> DataFrame:
        return self.frame.filter("live")

    def _changed(self, frame: DataFrame) -> None:
        self._steps, self._stale = (self._steps + 1) % self.STEPS, True
        self.frame = frame if self._steps else shared.kept(self.spark, frame, "vectors")

    def attach(self, rows: DataFrame, n: int) -> None:
        """rows: (_key, __i, embedding), __i from 0; a key that is attached already is replaced, the last of equal keys holds."""
        new = rows.select(KEY, (F.col("__i") + self.next_row).cast("long").alias("_vrow"), F.col("embedding").cast("array<float>").alias("embedding"))
        if self.plan.metric == Metric.COSINE:
            new = new.withColumn("embedding", normalised("embedding"))
        last = new.groupBy(KEY).agg(F.max("_vrow").alias("__last"))
        old = self.frame.join(last, KEY, "left").withColumn("live", F.col("live") & F.col("__last").isNull()).drop("__last")
        new = new.join(last, KEY).withColumn("live", F.col("_vrow") == F.col("__last")).drop("__last")
        self._changed(old.unionByName(new))
        self.next_row += n

    def kill(self, keys: DataFrame) -> None:
        gone = keys.select(KEY).distinct().withColumn("__gone", F.lit(True))
        self._changed(self.frame.join(gone, KEY, "left").withColumn("live", F.col("live") & F.col("__gone").isNull()).drop("__gone"))

    def compact(self) -> int:
        """Numbers the live vectors anew, in their order, and drops the others; how many these were."""
        kept = ranked(self.live().withColumnRenamed("_vrow", "__old"), "__old", "_vrow")
        before, after = self.frame.count(), kept.count()
        self.frame = kept.select(KEY, "_vrow", "embedding", "live")
        self.next_row, self._steps, self._stale = after, 0, True
        return before - after

    def index(self) -> CellIndex | None:
        if not self.indexed or self.plan.structure != VectorStructure.GRAPH:
            return None
        if self.graph is None or self._stale:
            self.graph = CellIndex(self.spark, self.live(), self.definition.dim, self.plan.metric, self.plan.cells, self.plan.seed, "_vrow", "embedding")
            self._stale = False
        return self.graph

    def ordered(self, found: DataFrame) -> DataFrame:
        order = F.col("score") if self.plan.metric == Metric.L2 else -F.col("score")
        return found.select(F.col(KEY).alias("key"), F.col("_vrow").alias("row"), "score").orderBy(order, "row")


class Table:
    def __init__(self, store: RecordStore, schema: Schema):
        self.store, self.spark = store, store.spark
        self.prefilter_threshold = P.PREFILTER_THRESHOLD
        saved = self._load_schema()
        if saved is not None and not saved.same_columns(schema):
            raise ValueError("the stored schema has columns that the new one drops or retypes")
        self.schema = store.schema = schema
        self.catalog = IndexCatalog.load(self._path("catalog.json"))
        self._layouts: dict[str, Layout] = {}
        self._rebuilds = 0
        self._vectors = {c.name: VectorColumn(self.spark, c) for c in schema.vector_columns()}
        self._load_vectors()

    @classmethod
    def open(cls, store: RecordStore) -> Table:
        saved = cls._load_schema_of(store)
        if saved is None:
            raise ValueError("no schema was saved here")
        return cls(store, saved)

    def _path(self, name: str) -> str:
        return f"{self.store.path}/{name}"

    @staticmethod
    def _load_schema_of(store: RecordStore) -> Schema | None:
        path = f"{store.path}/schema.json"
        return Schema.parse_json(shared.read_text(path, store.spark)) if shared.exists(path, store.spark) else None

    def _load_schema(self) -> Schema | None:
        return self._load_schema_of(self.store)

    # records

    def frame(self) -> DataFrame:
        """All records as rows of _key and typed columns."""
        return self.store.typed(self.schema)

    def __len__(self) -> int:
        return len(self.store)

    def add_column(self, column: ColumnDef) -> None:
        self.schema.add(column)
        if column.type == LogicalType.VECTOR:
            self._vectors[column.name] = VectorColumn(self.spark, self.schema.column(column.name))

    def put(self, record: Record) -> WriteResult:
        return self.put_batch([record])

    def put_batch(self, records: Iterable[Record]) -> WriteResult:
        """All records are checked before any is written; of records with one key the last holds."""
        records = list(records)
        for r in records:
            self.schema.validate(r)
        last = {r.key: r for r in records}
        there = self._existing(last)
        self.store.put_many(last.values())
        return self._written(len(records), len(last) - len(there))

    def put_frame(self, rows: DataFrame, key: str = "key", payload: str = "payload") -> WriteResult:
        """A frame of (key, map of texts), checked as a whole and then written; of rows with one key the last holds."""
        bad = rows.select(key, self.schema.problems(F.col(payload)).alias("p")).filter(F.col(key).isNull() | (F.size("p") > 0)).limit(1).collect()
        if bad:
            raise ValueError(f"record {bad[0][0]} has unfit columns: {', '.join(bad[0][1])}")
        created = rows.select(F.col(key).cast("long").alias("key")).distinct().join(self.store.keys(), "key", "left_anti").count()
        n = self.store.append_frame(rows.select(F.lit("put").alias("op"), F.col(key).alias("key"), F.col(payload).alias("payload")))
        return self._written(n, created)

    def _existing(self, keys) -> set[int]:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key long")
        return {r[0] for r in self.store.keys().join(F.broadcast(wanted), "key", "left_semi").collect()}  # no more than were passed in

    def _written(self, rows: int, created: int) -> WriteResult:
        """Layouts stay as they are: the log says what has changed since."""
        return WriteResult(created > 0, rows, created, len(self._layouts), 0)

    def update(self, key: int, changes: dict[str, str]) -> WriteResult:
        """Sets the named columns; the others stay. A key that isn't there is an error."""
        old = self.store.get(key)
        if old is None:
            raise KeyError(f"no record {key}")
        return self.put(Record(key, old.columns | changes))

    def erase(self, key: int) -> WriteResult:
        """No record, no change. The record's vectors go too."""
        if not self.store.delete(key):
            return WriteResult()
        gone = self.spark.createDataFrame([(key,)], f"{KEY} long")
        for v in self._vectors.values():
            v.kill(gone)
        return self._written(1, 0)

    def get(self, key: int) -> Record | None:
        return self.store.get(key)

    # queries

    POINTS = 1000  # records that are read by key, one condition on the snapshot's sorted keys

    def _layout(self, column: str) -> Layout | None:
        """The column's layout, built anew if the log no longer reaches back to it."""
        layout = self._layouts.get(column)
        if layout is not None and layout.lsn != self.store.lsn() and layout.lsn <= self.store.since():
            self.rebuild(column)
        return self._layouts.get(column)

    def _served(self, p: Predicate) -> Layout | None:
        p.check(self.schema)
        return self._layout(p.column) if op_is_indexable(p.op) else None

    def _changed(self, layout: Layout) -> DataFrame | None:
        """(_key and the scalars, _gone) of the keys written since the layout was built."""
        new = self.store.changes(layout.lsn - 1)
        return None if new is None else self.schema.typed(new).join(new.select(F.col("key").alias(KEY), F.col("payload").isNull().alias("_gone")), KEY)

    def _laid_over(self, keys: DataFrame, changed: DataFrame | None, condition) -> DataFrame:
        """keys (_key) of a layout, with what has changed since."""
        if changed is None:
            return keys
        return keys.join(changed.select(KEY), KEY, "left_anti").unionByName(changed.filter(~F.col("_gone") & condition).select(KEY))

    def _found(self, p: Predicate) -> tuple[DataFrame, P.QueryTrace]:
        """Keys that match a predicate, unordered, and the report."""
        condition, layout = p.compile(self.schema), self._served(p)
        if layout is None:
            why = f"no order helps {p.op.value!r}" if not op_is_indexable(p.op) else f"{p.column!r} has no layout of its own"
            rows = self.frame().filter(condition)
            return rows.select(KEY), P.QueryTrace(f"{why}: the records are scanned", False, self.__len__, rows.count)
        changed = self._changed(layout)
        keys = self._laid_over(layout.keys(p), changed, condition)
        matched = (lambda: layout.count(p)) if changed is None else keys.count
        said = f"{p.column!r} is laid out as {layout.plan.kind.value} ({layout.plan.encoding.value})"
        return keys, P.QueryTrace(said + (", with later writes over it" if changed is not None else ""), True, 0 if changed is None else changed.count, matched)

    def _records(self, condition, keys: DataFrame, trace: P.QueryTrace) -> DataFrame:
        """The records that fulfil a condition: by key, if a layout has found a few, else by a scan of the columns."""
        if trace.used_index:
            few = [r[0] for r in keys.limit(self.POINTS + 1).collect()]
            if len(few) <= self.POINTS:
                trace.reason += "; the records are read by key"
                return self.store.typed(self.schema, F.col("key").isin(few)).filter(condition)
            trace.reason += f"; more than {self.POINTS} records: their columns are scanned"
        return self.frame().filter(condition)

    def select(self, column, op=None, value=None, value2=None) -> tuple[DataFrame, P.QueryTrace]:
        p = column if isinstance(column, Predicate) else Predicate.of((column, op, value, value2))
        keys, trace = self._found(p)
        return self._records(p.compile(self.schema), keys, trace).orderBy(KEY), trace

    def select_keys(self, column, op=None, value=None, value2=None) -> tuple[DataFrame, P.QueryTrace]:
        keys, trace = self._found(column if isinstance(column, Predicate) else Predicate.of((column, op, value, value2)))
        return keys.orderBy(KEY), trace

    def count(self, column, op=None, value=None, value2=None) -> int:
        return self._found(column if isinstance(column, Predicate) else Predicate.of((column, op, value, value2)))[1].matched

    def estimate(self, column, op=None, value=None, value2=None) -> int:
        """How many rows a predicate can match: exact from a bitmap without later writes, else all rows."""
        p = column if isinstance(column, Predicate) else Predicate.of((column, op, value, value2))
        layout = self._served(p)
        exact = layout is not None and layout.plan.kind == IndexKind.BITMAP and self._changed(layout) is None
        return layout.count(p) if exact else len(self)

    def _bitmap_conjunction(self, predicates: list[Predicate]) -> list[Layout] | None:
        """The layouts, if every predicate can be answered by bitmaps that were built at the same place in the log."""
        layouts = [self._served(p) for p in predicates]
        fit = layouts and all(x is not None and x.plan.kind == IndexKind.BITMAP for x in layouts) and len({x.lsn for x in layouts}) == 1
        return layouts if fit else None

    def _all(self, predicates: list[Predicate]) -> tuple[DataFrame, P.QueryTrace, bool]:
        """Keys of the rows for which all hold, unordered; the report; whether bitmaps have answered alone."""
        test = all_of(predicates, self.schema)
        if not predicates:
            return self.frame().select(KEY), P.QueryTrace("no condition: every row", False, self.__len__, self.__len__), False
        if len(predicates) == 1:
            keys, trace = self._found(predicates[0])
            return keys, trace, self._bitmap_conjunction(predicates) is not None
        if layouts := self._bitmap_conjunction(predicates):
            both = bitmaps.intersection(*(x.operand(p) for x, p in zip(layouts, predicates, strict=True)))
            changed = self._changed(layouts[0])
            keys = self._laid_over(bitmaps.keys(both).withColumnRenamed("key", KEY), changed, test)
            matched = (lambda: bitmaps.count(both).first()[0]) if changed is None else keys.count
            return keys, P.QueryTrace(f"{len(predicates)} bitmaps are intersected", True, 0 if changed is None else changed.count, matched), True
        served = [(t.matched, p, k) for p in predicates if self._served(p) is not None for k, t in [self._found(p)]]
        least = min(served, key=lambda x: x[0], default=None)
        if least is not None and least[0] <= self.POINTS:
            n, p, found = least
            rows = self.store.typed(self.schema, F.col("key").isin([r[0] for r in found.collect()])).filter(test)
            return rows.select(KEY), P.QueryTrace(f"{p.column!r} is the most selective: its {n} records are read by key and tested", True, n, rows.count), False
        rows = self.frame().filter(test)
        return rows.select(KEY), P.QueryTrace("one scan tests all conditions", False, self.__len__, rows.count), False

    def select_all_records(self, predicates) -> tuple[DataFrame, P.QueryTrace]:
        """Rows for which all hold; none given: every row."""
        predicates = [Predicate.of(p) for p in predicates]
        keys, trace, _ = self._all(predicates)
        return self._records(all_of(predicates, self.schema), keys, trace).orderBy(KEY), trace

    def select_all(self, predicates) -> tuple[DataFrame, P.QueryTrace]:
        keys, trace, _ = self._all([Predicate.of(p) for p in predicates])
        return keys.orderBy(KEY), trace

    def select_any(self, predicates) -> tuple[DataFrame, P.QueryTrace]:
        """Rows for which one holds; none given: no row."""
        predicates = [Predicate.of(p) for p in predicates]
        test = any_of(predicates, self.schema)
        if predicates and all(self._served(p) is not None for p in predicates):
            found = [self._found(p) for p in predicates]
            keys = reduce(DataFrame.unionByName, (k for k, _ in found)).distinct()
            return keys.orderBy(KEY), P.QueryTrace("; ".join(t.reason for _, t in found), True, lambda: max(t.scanned for _, t in found), keys.count)
        rows = self.frame().filter(test)
        why = "one scan tests all conditions" if predicates else "no condition: no row"
        return rows.select(KEY).orderBy(KEY), P.QueryTrace(why, False, self.__len__, rows.count)

    def scan(self, limit: int = 0, offset: int = 0) -> DataFrame:
        """Records in key order; limit 0 means all."""
        rows = self.frame().orderBy(KEY).offset(offset)
        return rows.limit(limit) if limit > 0 else rows

    # layouts

    def _shape(self, column: str) -> ColumnShape:
        return measure_shape(self.frame(), column, KEY)

    def _values(self, column: str) -> DataFrame:
        return self.frame().select(KEY, F.col(f"`{column}`").alias("value")).filter("value is not null")

    def _measure(self, column: str):
        rows, made = shared.kept(self.spark, self._values(column), "values"), {}
        return lambda plan: measured(self.spark, rows, plan, self._path("measured"), made)

    def _lay(self, column: str, plan: IndexPlan) -> None:
        """Writes the layout of a plan and lets go of the one before."""
        old = self._layouts.get(column)
        self._layouts[column] = Layout.build(self.spark, self._values(column), plan, self._path(f"layout-{uuid.uuid4().hex}"), self.store.lsn())
        if old is not None:
            old.drop()

    def _scalar(self, column: str) -> ColumnDef:
        c = self.schema.column(column)
        if c.type == LogicalType.VECTOR:
            raise ValueError(f"{column!r} is a vector; create_vector_index is for those")
        return c

    def create_index(self, column: str, write_fraction: float = 0.0) -> ColumnInfo:
        """Chooses a layout by measuring those that can serve the column, unless the catalog knows, and writes it."""
        c, shape = self._scalar(column), self._shape(column)
        plan, _ = self.catalog.build_column(column, c.type, shape, self._measure(column), write_fraction)
        shared.delete(self._path("measured"), self.spark)
        self._lay(column, plan)
        return self.info(column)

    def create_index_as(self, column: str, kind: IndexKind, write_fraction: float = 0.0) -> ColumnInfo:
        c, shape, kind = self._scalar(column), self._shape(column), IndexKind(kind)
        check_kind(c.type, kind, shape.unique)
        encoding = KeyEncoding.DICTIONARY if kind == IndexKind.BITMAP else KeyEncoding.NATIVE if shape.unique else KeyEncoding.COMPOSITE
        plan = IndexPlan(kind, c.type, encoding, rmi_models=max(1, min(IndexPlan.rmi_models, shape.rows)))
        plan = fingerprinted(replace(self._measure(column)(plan), write_fraction=write_fraction), shape)
        shared.delete(self._path("measured"), self.spark)
        self._lay(column, plan)
        self.catalog.set(column, plan)
        return self.info(column)

    def drop_index(self, column: str) -> bool:
        self.catalog.erase(column)
        layout = self._layouts.pop(column, None)
        if layout is not None:
            layout.drop()
        return layout is not None

    def has_index(self, column: str) -> bool:
        return column in self._layouts

    def explain_column(self, column: str) -> IndexPlan | None:
        return self._layouts[column].plan if column in self._layouts else self.catalog.get(column)

    def freshness(self, column: str) -> str:
        return self.catalog.freshness(column, self._shape(column))

    def rebuild(self, column: str) -> None:
        """Writes the layout anew, as sorted pairs if the values no longer allow what it was."""
        if column not in self._layouts:
            raise KeyError(f"{column!r} has no index")
        shape, plan = self._shape(column), fingerprinted(self._layouts[column].plan, self._shape(column))
        if plan.kind in LEARNED and not shape.unique:
            plan = replace(plan, kind=IndexKind.BTREE, encoding=KeyEncoding.COMPOSITE)
        self._lay(column, plan)
        self.catalog.set(column, plan)
        self._rebuilds += 1

    def rebuilds(self) -> int:
        return self._rebuilds

    def info(self, column: str) -> ColumnInfo:
        c, shape, layout = self._scalar(column), self._shape(column), self._layouts.get(column)
        plan = None if layout is None else layout.plan
        dirty = layout is not None and layout.lsn != self.store.lsn()
        extra = {} if plan is None else {"kind": plan.kind, "encoding": plan.encoding, "index_bytes": plan.index_bytes, "ns_per_lookup": plan.ns_per_lookup}
        return ColumnInfo(column, c.type, plan is not None, shape.rows, len(self) - shape.rows, shape.distinct, shape.unique, shape.monotone, dirty, **extra)

    def describe(self) -> list[ColumnInfo]:
        return [self.info(c.name) for c in self.schema.scalar_columns()]

    # vectors

    def _vector(self, column: str) -> VectorColumn:
        if self.schema.type_of(column) != LogicalType.VECTOR:
            raise ValueError(f"{column!r} is no vector")
        return self._vectors[column]

    def create_vector_index(self, column: str, plan: VectorPlan = VectorPlan()) -> VectorInfo:
        v = self._vector(column)
        if plan.metric != v.plan.metric and v.next_row:
            raise ValueError("vectors are there; their metric can't change")
        v.plan, v.indexed, v._stale = plan, True, True
        return self.vector_info(column)

    def drop_vector_index(self, column: str) -> bool:
        v = self._vector(column)
        was, v.indexed, v.graph = v.indexed, False, None
        return was

    def has_vector_index(self, column: str) -> bool:
        return self._vector(column).indexed

    def put_vector(self, key: int, column: str, vector) -> int:
        self.put_vectors(column, [key], [vector])
        return self._vector(column).next_row - 1

    def put_vectors(self, column: str, keys, vectors) -> int:
        """One row of the matrix for each key; all keys must have a record."""
        v, data = self._vector(column), np.asarray(vectors, np.float32)
        if data.ndim != 2 or data.shape != (len(keys), v.definition.dim):
            raise ValueError(f"{len(keys)} vectors of {v.definition.dim} dimensions are wanted, not {data.shape}")
        rows = self.spark.createDataFrame([(int(k), i, x.tolist()) for i, (k, x) in enumerate(zip(keys, data, strict=True))], f"{KEY} long, __i long, embedding array<float>")
        return self._attach(v, rows, len(keys))

    def put_vector_frame(self, column: str, rows: DataFrame, key: str, vector: str) -> int:
        """As put_vectors, for a frame; its rows are numbered in key order."""
        v = self._vector(column)
        if rows.filter(F.coalesce(F.size(vector) != v.definition.dim, F.lit(True))).limit(1).count():
            raise ValueError(f"vectors of {v.definition.dim} dimensions are wanted")
        numbered = ranked(rows.select(F.col(key).alias(KEY), F.col(vector).alias("embedding")), KEY, "__i")
        return self._attach(v, numbered, numbered.count())

    def _attach(self, v: VectorColumn, rows: DataFrame, n: int) -> int:
        missing = rows.select(F.col(KEY).alias("key")).join(self.store.keys(), "key", "left_anti").limit(1).collect()
        if missing:
            raise KeyError(f"no record {missing[0][0]}")
        v.attach(rows, n)
        return n

    def erase_vector(self, key: int, column: str) -> bool:
        if not self.has_vector(key, column):
            return False
        self._vector(column).kill(self.spark.createDataFrame([(key,)], f"{KEY} long"))
        return True

    def has_vector(self, key: int, column: str) -> bool:
        return self._vector(column).live().filter(F.col(KEY) == key).limit(1).count() > 0

    def get_vector(self, key: int, column: str) -> np.ndarray | None:
        """As stored: under cosine of length one."""
        row = self._vector(column).live().filter(F.col(KEY) == key).first()
        return None if row is None else np.array(row["embedding"], np.float32)

    def vector_keys(self, column: str) -> DataFrame:
        return self._vector(column).live().orderBy("_vrow").select(KEY)

    def compact_vectors(self, column: str) -> int:
        return self._vector(column).compact()

    def vector_info(self, column: str) -> VectorInfo:
        v = self._vector(column)
        n, rows, same = v.frame.agg(F.count("*"), F.coalesce(F.sum(F.col("live").cast("long")), F.lit(0)), F.coalesce(F.min(F.col(KEY) == F.col("_vrow")), F.lit(True))).first()
        return VectorInfo(column, v.definition.dim, v.indexed, rows, n - rows, v.plan.structure, v.plan.metric, v.indexed and v.plan.structure == VectorStructure.GRAPH, same, n * v.definition.dim * 4)

    def describe_vectors(self) -> list[VectorInfo]:
        return [self.vector_info(c.name) for c in self.schema.vector_columns()]

    def knn(self, column: str, query, k: int = 10, ef: int = 0, exact: bool = False) -> DataFrame:
        """(key, row, score) of the k nearest live vectors, best first."""
        v = self._vector(column)
        check_query(query, v.definition.dim)
        graph = None if exact else v.index()
        found = graph.search(query, k, ef or v.plan.ef_search) if graph else search(v.live(), query, k, v.plan.metric, "_vrow", "embedding")
        return v.ordered(found)

    def knn_by_key(self, column: str, key: int, k: int = 10, ef: int = 0, exact: bool = False) -> DataFrame:
        """Nearest to the vector of a record, which isn't among them itself."""
        seed = self.get_vector(key, column)
        if seed is None:
            raise KeyError(f"record {key} has no vector {column!r}")
        return self.knn(column, seed, k + 1, ef, exact).filter(F.col("key") != key).limit(k)

    # both

    def _resolve(self, predicates, column: str) -> tuple[DataFrame, P.HybridTrace]:
        """Rows of the vectors whose records match, and the report so far; one pass counts both."""
        v = self._vector(column)
        keys, structured, mask = self._all([Predicate.of(p) for p in predicates])
        joined = keys.join(v.live().select(KEY, "_vrow"), KEY, "left")
        matched, without = joined.agg(F.count("*"), F.coalesce(F.sum(F.col("_vrow").isNull().cast("long")), F.lit(0))).first()
        trace = P.QueryTrace(structured.reason, structured.used_index, lambda: structured.scanned, matched)
        return joined.filter("_vrow is not null").select("_vrow"), P.HybridTrace(trace, P.QueryPlan(), without, mask)

    def explain_hybrid(self, predicates, column: str, k: int = 10) -> P.HybridTrace:
        return self._explain(predicates, column, k)[1]

    def _explain(self, predicates, column: str, k: int) -> tuple[DataFrame | None, P.HybridTrace]:
        v = self._vector(column)
        if not predicates:
            n = v.live().count()
            return None, P.HybridTrace(P.QueryTrace("no condition", False, 0, n), P.QueryPlan(PlanKind.NO_PREDICATE, n, n, 1.0 if n else 0.0, self.prefilter_threshold, True, "no condition"))
        allowed, trace = self._resolve(predicates, column)
        corpus = v.frame.count()  # with orphans: they are in the way of a search too
        trace.plan = P.decide(trace.structured.matched - trace.without_vector, corpus, k, self.prefilter_threshold, v.index() is not None, trace.mask_used)
        return allowed, trace

    def hybrid(self, predicates, column: str, query, k: int = 10, ef: int = 0) -> tuple[DataFrame, P.HybridTrace]:
        allowed, trace = self._explain(predicates, column, k)
        if allowed is None:
            return self.knn(column, query, k, ef), trace
        return self._run(trace.plan.kind, allowed, column, query, k, ef), trace

    def hybrid_with(self, kind: PlanKind, predicates, column: str, query, k: int = 10, ef: int = 0) -> tuple[DataFrame, P.HybridTrace]:
        kind = PlanKind(kind)
        if not self.plan_available(kind, predicates, column):
            raise ValueError(f"{kind.value} is not available here")
        allowed, trace = self._resolve(predicates, column)
        trace.plan = P.QueryPlan(kind, trace.structured.matched - trace.without_vector, self._vector(column).frame.count(), threshold=self.prefilter_threshold, reason="asked for")
        return self._run(kind, allowed, column, query, k, ef), trace

    def _run(self, kind, allowed, column, query, k, ef) -> DataFrame:
        v = self._vector(column)
        check_query(query, v.definition.dim)
        return v.ordered(P.execute(kind, v.live(), query, k, ef or v.plan.ef_search, v.plan.metric, allowed, v.index(), "_vrow", "embedding"))

    def plan_available(self, kind: PlanKind, predicates, column: str) -> bool:
        kind, has_graph = PlanKind(kind), self._vector(column).index() is not None
        if kind == PlanKind.FILTERED_GRAPH:
            return has_graph
        if kind == PlanKind.BITMAP_FILTERED_GRAPH:
            return has_graph and self._bitmap_conjunction([Predicate.of(p) for p in predicates]) is not None
        return True

    def calibrate(self, column: str, queries, k: int = 10, ef: int = 0, samples: int = 12) -> float:
        v = self._vector(column)
        self.prefilter_threshold = P.calibrate(v.live(), v.index(), queries, k, ef, samples, v.plan.metric, self.prefilter_threshold, "_vrow", "embedding")
        return self.prefilter_threshold

    # keeping

    def save_vectors(self) -> None:
        meta = []
        for k, (name, v) in enumerate(self._vectors.items()):
            folder = f"vectors-{k}-{uuid.uuid4().hex}"
            v.frame.write.parquet(self._path(folder))
            v.frame = self.spark.read.parquet(self._path(folder))
            meta.append({"name": name, "folder": folder, "dim": v.definition.dim, "metric": v.plan.metric.value, "structure": v.plan.structure.value, "cells": v.plan.cells, "ef_search": v.plan.ef_search, "seed": v.plan.seed, "next_row": v.next_row, "indexed": v.indexed})
        shared.atomic_write(self._path("vectors.json"), json.dumps({"version": 1, "vectors": meta}), self.spark)
        for old in shared.names(self.store.path, self.spark):
            if old.startswith("vectors-") and old not in {m["folder"] for m in meta}:
                shared.delete(self._path(old), self.spark)

    def _load_vectors(self) -> None:
        if not shared.exists(self._path("vectors.json"), self.spark):
            return
        for m in json.loads(shared.read_text(self._path("vectors.json"), self.spark))["vectors"]:
            v = self._vectors.get(m["name"])
            if v is None:
                continue
            if v.definition.dim != m["dim"]:
                raise ValueError(f"the stored vectors {m['name']!r} have {m['dim']} dimensions")
            v.plan = VectorPlan(VectorStructure(m["structure"]), Metric(m["metric"]), m["cells"], m["ef_search"], m["seed"])
            v.next_row, v.indexed = m["next_row"], m["indexed"]
            v.frame = self.spark.read.parquet(self._path(m["folder"]))

    def export_fvecs(self, column: str, path: str) -> int:
        """The live vectors in row order, in the fvecs format."""
        return write_fvecs(self._vector(column).live().select("_vrow", "embedding"), path, "_vrow", "embedding")

    def save(self) -> None:
        """Schema, vectors and catalog."""
        shared.atomic_write(self._path("schema.json"), self.schema.serialize(), self.spark)
        self.save_vectors()
        self.catalog.save(self._path("catalog.json"))

    def checkpoint(self) -> None:
        """Writes everything as a new snapshot; layouts without later writes go on, the others are built anew."""
        self.save()
        current = [c for c, x in self._layouts.items() if x.lsn == self.store.lsn()]
        self.store.checkpoint()
        for column in list(self._layouts):
            if column in current:
                self._layouts[column].lsn = self.store.lsn()
            else:
                self.rebuild(column)

    def validate(self) -> None:
        """Every stored text is a value of its column, and every live vector has a record; else an error."""
        rows = self.store.frame()
        bad = rows.select("key", self.schema.problems(F.col("payload")).alias("p")).filter(F.size("p") > 0).limit(1).collect()
        if bad:
            raise ValueError(f"record {bad[0][0]} has unfit columns: {', '.join(bad[0][1])}")
        for name, v in self._vectors.items():
            lost = v.live().join(rows.select(F.col("key").alias(KEY)), KEY, "left_anti").limit(1).collect()
            if lost:
                raise ValueError(f"the vector {name!r} of {lost[0][0]} has no record")
