"""Physical layouts of a column: files that answer predicates on it without a look at the records.

    btree               (value, _key) by value and key, in sorted range partitions: row groups that can't match are skipped
    rmi, dynamic_rmi    the same with the position of each value, and the models that predict it: a point read asks for
                        the positions of its model's window only
    bitmap              a bitmap of keys by value and stretch of 32,768 keys, sorted by value

A layout knows the log position it was built at. Writes since then are laid over it from the log (merge on read).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predicates import Predicate, PredOp
from tessera.functions.schema import ColumnDef, Schema
from tessera.functions.types import IndexKind, LogicalType, literal
from tessera.operators import bitmaps, learned
from tessera.plans.catalog import IndexPlan, timed
from tessera.sources import shared

KEY = "_key"
LEARNED = (IndexKind.RMI, IndexKind.DYNAMIC_RMI)


def _number(value: Column, kind: LogicalType) -> Column:
    """The value as the number that a model is fitted to."""
    return F.unix_micros(value) if kind == LogicalType.TIMESTAMP else value


class Layout:
    def __init__(self, spark: SparkSession, folder: str, plan: IndexPlan, lsn: int):
        self.spark, self.folder, self.plan, self.lsn = spark, folder, plan, lsn
        self.schema = Schema([ColumnDef("value", plan.type)])
        self.rows = spark.read.parquet(f"{folder}/rows")
        if plan.kind in LEARNED:
            meta = json.loads(shared.read_text(f"{folder}/models.json", spark))
            self.models, self.stage1 = spark.read.parquet(f"{folder}/models"), tuple(meta["stage1"])
            self.size, self.count_of_models = meta["size"], meta["models"]

    @staticmethod
    def build(spark: SparkSession, rows: DataFrame, plan: IndexPlan, folder: str, lsn: int = 0) -> Layout:
        """rows: (_key, value), without nulls; the values unique where the layout is learned."""
        if plan.kind == IndexKind.BITMAP:
            if rows.filter(F.col(KEY) < 0).limit(1).count():
                raise ValueError("a bitmap has no place for negative keys")
            bitmaps.build(rows, "value", KEY).repartitionByRange("value", "bucket").sortWithinPartitions("value", "bucket").write.parquet(f"{folder}/rows")
        elif plan.kind in LEARNED:
            number = _number(F.col("value"), plan.type)
            rmi = learned.fit(rows.select(number.alias("key")), plan.rmi_models)
            placed = rows.withColumn("key", number).join(rmi.keys.select("key", "pos"), "key")
            placed.select("value", KEY, "pos").repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{folder}/rows")
            rmi.models.select("model", "slope", "intercept", "back", "fwd").write.parquet(f"{folder}/models")
            shared.atomic_write(f"{folder}/models.json", json.dumps({"stage1": [float(x) for x in rmi.stage1], "size": rmi.size, "models": rmi.count}), spark)
        else:
            rows.select("value", KEY).repartitionByRange("value", KEY).sortWithinPartitions("value", KEY).write.parquet(f"{folder}/rows")
        return Layout(spark, folder, plan, lsn)

    def drop(self) -> None:
        shared.delete(self.folder, self.spark)

    def nbytes(self) -> int:
        return shared.size(self.folder, self.spark)

    def _condition(self, p: Predicate) -> Column:
        return replace(p, column="value").compile(self.schema)

    def window(self, value) -> tuple[int, int]:
        """First and last position at which a value can be: its model's prediction with its errors; (0, -1) if it has none."""
        number = _number(literal(self.plan.type, value), self.plan.type)
        rmi = learned.Rmi(self.rows, self.models, self.stage1, self.size, self.count_of_models)
        one = self.spark.range(1).select(number.alias("key"), rmi.route(number).alias("model"))
        guess = learned.clamped(F.col("slope") * F.col("key").cast("double") + F.col("intercept"), self.size)
        found = one.join(self.models, "model").select(guess - F.col("back"), guess + F.col("fwd")).first()
        return tuple(found) if found else (0, -1)

    def operand(self, p: Predicate) -> DataFrame:
        """(bucket, bits) of a bitmap layout."""
        return bitmaps.run(self.rows, self._condition(p))

    def _matching(self, p: Predicate) -> DataFrame:
        rows = self.rows
        if self.plan.kind in LEARNED and p.op == PredOp.EQ:
            first, last = self.window(p.value)
            rows = rows.filter(F.col("pos").between(first, last))
        return rows.filter(self._condition(p))

    def keys(self, p: Predicate) -> DataFrame:
        """(_key) of the rows that match."""
        if self.plan.kind == IndexKind.BITMAP:
            return bitmaps.keys(self.operand(p)).withColumnRenamed("key", KEY)
        return self._matching(p).select(KEY)

    def count(self, p: Predicate) -> int:
        return bitmaps.count(self.operand(p)).first()[0] if self.plan.kind == IndexKind.BITMAP else self._matching(p).count()


def measured(spark: SparkSession, rows: DataFrame, plan: IndexPlan, folder: str, made: dict) -> IndexPlan:
    """The plan with what building its layout and a point read in it took here. `made` remembers layouts that differ in
    nothing but when they are merged. A write is charged its share of the next rebuild, which is due when the pending
    changes reach merge_ratio of the rows."""
    what = ("learned", plan.rmi_models) if plan.kind in LEARNED else plan.kind
    if what not in made:
        at = f"{folder}/{uuid.uuid4().hex}"
        began = time.perf_counter_ns()
        layout = Layout.build(spark, rows, plan, at)
        took, n = time.perf_counter_ns() - began, rows.count()
        probe = rows.select("value").first()
        value = None if probe is None else probe[0]
        ns = 0.0
        if value is not None:
            want = Predicate("value", PredOp.EQ, to_literal(plan.type, value))
            ns = timed(lambda: layout.count(want))
        made[what] = (ns, took, n, layout.nbytes())
        layout.drop()
    ns, took, n, size = made[what]
    return replace(plan, ns_per_lookup=ns, ns_per_write=took / max(1.0, plan.merge_ratio * n), index_bytes=size)


def to_literal(kind: LogicalType, value):
    """A value as Spark returns it, as predicates take it."""
    if LogicalType(kind) == LogicalType.TIMESTAMP:
        import datetime

        return round((value.astimezone(datetime.timezone.utc) - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).total_seconds() * 1000)
    return value
