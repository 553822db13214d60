import pytest
from pyspark.sql import functions as F

from tessera.functions import types as X
from tessera.functions.predicates import Predicate, PredOp, compare_op_of, op_is_indexable
from tessera.functions.schema import ColumnDef, Record, Schema
from tessera.functions.types import LogicalType as L

GOOD = {
    L.INT64: {"12": 12, " 12": 12, "+3": 3, "-9223372036854775808": -(1 << 63), "007": 7},
    L.DOUBLE: {"1.5": 1.5, ".5": 0.5, "5.": 5.0, "-1e3": -1000.0, " 2": 2.0},
    L.BOOL: {"true": True, "FALSE": False, "1": True, "0": False},
    L.TIMESTAMP: {"0": 0, "-5": -5, "1970-01-02": 86_400_000, "2026-08-13T14:30:00Z": 1786631400000, "2026-08-13 14:30": 1786631400000, "2026-02-31": 1772496000000, "1970-01-01T00:00:60": 60_000, "1970-01-01T00:00:00.1239Z": 123, "1969-12-31T23:59:59.5": -500},
}
BAD = {
    L.INT64: ["", "12 ", "1.0", "x", "9223372036854775808", "--1", "１２"],
    L.DOUBLE: ["", "nan", "inf", "-Infinity", "1e400", "1d", "1.5f", "1 ", "."],
    L.BOOL: ["", "yes", "t", " true", "2"],
    L.TIMESTAMP: ["", "2026-08", "2026-13-01", "2026-01-32", "2026-01-01T24:00", "2026-01-01T10:00+02:00", "2026-01-01T", "2026-1-1", "2026-01-01T10:00:00Zx"],
}


@pytest.mark.parametrize("kind", list(GOOD))
def test_strict_reading(spark, kind):
    for text, value in GOOD[kind].items():
        assert X.parse_value(kind, text) == value
    for text in BAD[kind]:
        with pytest.raises(ValueError):
            X.parse_value(kind, text)
    rows = [(t,) for t in [*GOOD[kind], *BAD[kind], None]]
    v = X.parsed(F.col("t"), kind)
    v = F.unix_millis(v) if kind == L.TIMESTAMP else v
    got = {r["t"]: (r["v"], r["ok"]) for r in spark.createDataFrame(rows, "t string").select("t", v.alias("v"), X.is_valid(F.col("t"), kind).alias("ok")).collect()}
    assert got == {t: (x, True) for t, x in GOOD[kind].items()} | {t: (None, False) for t in BAD[kind]} | {None: (None, True)}


def test_hex_doubles_read_in_python():
    assert X.parse_value(L.DOUBLE, "0x1p3") == 8.0


def test_printing(spark):
    assert X.format_value(L.TIMESTAMP, 0) == "1970-01-01T00:00:00Z" and X.format_value(L.TIMESTAMP, -500) == "1969-12-31T23:59:59.500Z"
    assert X.format_value(L.DOUBLE, 0.1) == "0.10000000000000001" and X.format_value(L.BOOL, True) == "true"
    for ms in (0, 1786631400123, -1):
        assert X.parse_value(L.TIMESTAMP, X.format_value(L.TIMESTAMP, ms)) == ms
    row = spark.range(1).select(X.formatted(F.timestamp_millis(F.lit(1786631400123)), L.TIMESTAMP).alias("t")).first()
    assert row["t"] == "2026-08-13T14:30:00.123Z"


def test_prefix_upper_bound():
    assert X.prefix_upper_bound("ab") == b"ac" and X.prefix_upper_bound(b"a\xff") == b"b" and X.prefix_upper_bound(b"\xff") is None and X.prefix_upper_bound("") is None


SCHEMA = Schema([ColumnDef("n", L.INT64), ColumnDef("x", L.DOUBLE), ColumnDef("s", L.STRING), ColumnDef("b", L.BOOL), ColumnDef("t", L.TIMESTAMP), ColumnDef("v", L.VECTOR, 3)])


def test_schema():
    again = Schema.parse_json(SCHEMA.serialize())
    assert again.columns() == SCHEMA.columns() and len(again) == 6 and "n" in again
    assert SCHEMA.accepts(Record(1, {"n": "5"})) and SCHEMA.accepts(Record(1))
    for bad in ({"n": "x"}, {"nope": "1"}, {"v": "1"}):
        assert not SCHEMA.accepts(Record(1, bad))
    for bad in (ColumnDef("n", L.INT64), ColumnDef("", L.INT64), ColumnDef("w", L.VECTOR), ColumnDef("w", L.INT64, 3)):
        with pytest.raises(ValueError):
            SCHEMA.add(bad)
    assert not SCHEMA.same_columns(Schema([ColumnDef("n", L.STRING)])) and Schema([ColumnDef("n", L.INT64)]).same_columns(SCHEMA)


@pytest.mark.parametrize("column, op, value", [("n", "=", "1"), ("x", "<", 1), ("n", "=", True), ("b", "=", 1), ("s", "=", 5), ("t", "=", "2026-01-01"), ("n", "prefix", "a"), ("v", "=", 1.0)])
def test_no_coercion(column, op, value):
    with pytest.raises(TypeError):
        Predicate(column, PredOp(op), value).compile(SCHEMA)


def test_predicates_in_words():
    assert Predicate("n", PredOp.BETWEEN, 1, 2).describe(L.INT64) == "n between 1 and 2"
    assert Predicate("s", PredOp.PREFIX, "a").describe(L.STRING) == "s like 'a%'" and Predicate("s", PredOp.CONTAINS, "a").describe(L.STRING) == "s like '%a%'"
    assert Predicate("s", PredOp.IS_NULL).describe(L.STRING) == "s is null"
    assert not op_is_indexable(PredOp.CONTAINS) and compare_op_of(PredOp.LE).value == "<="
    with pytest.raises(ValueError):
        compare_op_of(PredOp.PREFIX)
    with pytest.raises(KeyError):
        Predicate("zz", PredOp.EQ, 1).compile(SCHEMA)
