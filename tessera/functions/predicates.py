"""Predicates: nine operators on one column each, checked against the schema before they become Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.schema import Schema
from tessera.functions.types import LogicalType, check_literal, format_value, literal


class PredOp(str, Enum):
    EQ = "="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="
    BETWEEN = "between"
    PREFIX = "prefix"
    CONTAINS = "contains"
    IS_NULL = "is null"


class CompareOp(str, Enum):
    EQ = "="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="


def op_is_indexable(op: PredOp) -> bool:
    return op not in (PredOp.CONTAINS, PredOp.IS_NULL)


def op_needs_second_value(op: PredOp) -> bool:
    return op == PredOp.BETWEEN


def op_is_string_only(op: PredOp) -> bool:
    return op in (PredOp.PREFIX, PredOp.CONTAINS)


def compare_op_of(op: PredOp) -> CompareOp:
    return CompareOp(op.value)  # ValueError for the others


@dataclass(frozen=True)
class Predicate:
    column: str
    op: PredOp
    value: Any = None
    value2: Any = None

    @staticmethod
    def of(p) -> Predicate:
        """A predicate, or a tuple (column, op, value[, value2])."""
        return p if isinstance(p, Predicate) else Predicate(p[0], PredOp(p[1]), *p[2:])

    def describe(self, kind: LogicalType) -> str:
        if self.op == PredOp.IS_NULL:
            return f"{self.column} is null"
        said = format_value(kind, self.value)
        if self.op == PredOp.BETWEEN:
            return f"{self.column} between {said} and {format_value(kind, self.value2)}"
        if op_is_string_only(self.op):
            return f"{self.column} like '{'%' * (self.op == PredOp.CONTAINS)}{said}%'"
        return f"{self.column} {self.op.value} {said}"

    def check(self, schema: Schema) -> LogicalType:
        """The column's type; an error if the column is unknown or the operator or a value doesn't fit it."""
        kind = schema.type_of(self.column)
        if kind == LogicalType.VECTOR:
            raise TypeError(f"{self.column!r} is a vector; predicates are on scalars")
        if self.op == PredOp.IS_NULL:
            return kind
        if op_is_string_only(self.op) and kind != LogicalType.STRING:
            raise TypeError(f"{self.op.value!r} is for strings, {self.column!r} is {kind.value}")
        check_literal(kind, self.value)
        if self.op == PredOp.BETWEEN:
            check_literal(kind, self.value2)
        return kind

    def compile(self, schema: Schema) -> Column:
        kind, c = self.check(schema), F.col(f"`{self.column}`")
        if self.op == PredOp.IS_NULL:
            return c.isNull()
        v = literal(kind, self.value)
        return {
            PredOp.EQ: lambda: c == v,
            PredOp.LT: lambda: c < v,
            PredOp.LE: lambda: c <= v,
            PredOp.GT: lambda: c > v,
            PredOp.GE: lambda: c >= v,
            PredOp.BETWEEN: lambda: c.between(v, literal(kind, self.value2)),
            PredOp.PREFIX: lambda: c.startswith(self.value),
            PredOp.CONTAINS: lambda: c.contains(self.value),
        }[self.op]()


def all_of(predicates, schema: Schema) -> Column:
    """No predicates: every row."""
    return reduce(lambda a, b: a & b, (Predicate.of(p).compile(schema) for p in predicates), F.lit(True))


def any_of(predicates, schema: Schema) -> Column:
    """No predicates: no row."""
    return reduce(lambda a, b: a | b, (Predicate.of(p).compile(schema) for p in predicates), F.lit(False))
