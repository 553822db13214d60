"""Declared schemas: typed columns, checked rows, JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import SPARK_TYPES, LogicalType, format_value, is_valid, parse_value, parsed


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: LogicalType
    dim: int = 0


@dataclass
class Record:
    """A key and the texts of the columns that are present."""

    key: int
    columns: dict[str, str] = field(default_factory=dict)

    def get(self, name: str, default: str = "") -> str:
        return self.columns.get(name, default)

    def set(self, name: str, value: str) -> None:
        self.columns[name] = value

    def unset(self, name: str) -> None:
        self.columns.pop(name, None)


class Schema:
    def __init__(self, columns=()):
        self._columns: dict[str, ColumnDef] = {}
        for c in columns:
            self.add(c)

    def add(self, column: ColumnDef) -> None:
        kind = LogicalType(column.type)
        if not column.name or column.name in self._columns:
            raise ValueError(f"column name {column.name!r} is empty or taken")
        if kind == LogicalType.VECTOR and column.dim <= 0:
            raise ValueError(f"vector column {column.name!r} needs a dimension")
        if kind != LogicalType.VECTOR and column.dim:
            raise ValueError(f"only vectors have a dimension, {column.name!r} is {kind.value}")
        self._columns[column.name] = ColumnDef(column.name, kind, column.dim)

    def has(self, name: str) -> bool:
        return name in self._columns

    __contains__ = has

    def __len__(self) -> int:
        return len(self._columns)

    def column(self, name: str) -> ColumnDef:
        if name not in self._columns:
            raise KeyError(f"no column {name!r}; there are {', '.join(self._columns) or 'none'}")
        return self._columns[name]

    def type_of(self, name: str) -> LogicalType:
        return self.column(name).type

    def columns(self) -> list[ColumnDef]:
        return list(self._columns.values())

    def scalar_columns(self) -> list[ColumnDef]:
        return [c for c in self.columns() if c.type != LogicalType.VECTOR]

    def vector_columns(self) -> list[ColumnDef]:
        return [c for c in self.columns() if c.type == LogicalType.VECTOR]

    def parse(self, name: str, text: str):
        return parse_value(self.type_of(name), text)

    def format(self, name: str, value) -> str:
        return format_value(self.type_of(name), value)

    def validate(self, record: Record) -> None:
        """Unknown columns, vectors and texts that don't fit are errors; missing columns are absent."""
        for name, text in record.columns.items():
            if self.type_of(name) == LogicalType.VECTOR:
                raise ValueError(f"{name!r} is a vector; vectors are not part of a record")
            self.parse(name, text)

    def accepts(self, record: Record) -> bool:
        try:
            self.validate(record)
        except (KeyError, ValueError):
            return False
        return True

    def problems(self, payload: Column) -> Column:
        """For a map of texts: the names of its columns that are unknown, vectors, or hold no such value."""
        bad = [F.filter(F.map_keys(payload), lambda k: ~k.isin(*[c.name for c in self.scalar_columns()]))]
        bad += [F.when(~is_valid(payload[c.name], c.type), F.array(F.lit(c.name))).otherwise(F.array().cast("array<string>")) for c in self.scalar_columns()]
        return F.coalesce(F.concat(*bad), F.array().cast("array<string>"))

    def value(self, column: ColumnDef, payload: Column) -> Column:
        """The column's value in a map of texts."""
        return parsed(payload[column.name], column.type)

    def typed(self, log: DataFrame, key: str = "key", payload: str = "payload") -> DataFrame:
        """Rows with a key and a map of texts, as rows of _key and typed columns."""
        return log.select(F.col(key).alias("_key"), *(self.value(c, F.col(payload)).alias(c.name) for c in self.scalar_columns()))

    def struct(self) -> T.StructType:
        fields = [T.StructField("_key", T.LongType(), False)]
        fields += [T.StructField(c.name, SPARK_TYPES[c.type], True, {"logical_type": c.type.value, "dim": c.dim}) for c in self.columns()]
        return T.StructType(fields)

    def serialize(self) -> str:
        return json.dumps({"version": 1, "columns": [{"name": c.name, "type": c.type.value, "dim": c.dim} for c in self.columns()]})

    @staticmethod
    def parse_json(blob: str) -> Schema:
        return Schema(ColumnDef(c["name"], LogicalType(c["type"]), c.get("dim", 0)) for c in json.loads(blob)["columns"])

    def same_columns(self, other: Schema) -> bool:
        """Whether other has all columns of this schema, with the same types; it may have more."""
        return all(other.has(c.name) and other.type_of(c.name) == c.type for c in self.columns())
