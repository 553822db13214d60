"""Logical types: strict reading and printing of values, in Python and as columns.

Text that Spark's casts would let pass (blanks behind a number, `nan`, `yes`, time zone offsets) is refused here, so a
column that was read never holds NaN or infinity. Timestamps are milliseconds since 1970 in UTC outside Spark and
TimestampType inside.
"""

from __future__ import annotations

import datetime
import math
import re
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LogicalType(str, Enum):
    INT64 = "int64"
    DOUBLE = "double"
    STRING = "string"
    BOOL = "bool"
    TIMESTAMP = "timestamp"
    VECTOR = "vector"


class KeyEncoding(str, Enum):
    NATIVE = "native"
    COMPOSITE = "composite"
    POSITION = "position"
    DICTIONARY = "dictionary"


class IndexKind(str, Enum):
    BTREE = "btree"
    RMI = "rmi"
    DYNAMIC_RMI = "dynamic_rmi"
    BITMAP = "bitmap"


class Metric(str, Enum):
    L2 = "l2"
    INNER_PRODUCT = "inner_product"
    COSINE = "cosine"


class VectorStructure(str, Enum):
    EXACT = "exact"
    GRAPH = "graph"


class PlanKind(str, Enum):
    NO_PREDICATE = "no_predicate"
    PRE_FILTER = "pre_filter"
    FILTERED_GRAPH = "filtered_graph"
    BITMAP_FILTERED_GRAPH = "bitmap_filtered_graph"
    POST_FILTER = "post_filter"


SPARK_TYPES = {
    LogicalType.INT64: T.LongType(),
    LogicalType.DOUBLE: T.DoubleType(),
    LogicalType.STRING: T.StringType(),
    LogicalType.BOOL: T.BooleanType(),
    LogicalType.TIMESTAMP: T.TimestampType(),
    LogicalType.VECTOR: T.ArrayType(T.FloatType(), False),
}

EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
_LEAD = r"[ \t\n\x0B\f\r]*"  # blanks are let pass before a number, never behind it
_INT = re.compile(_LEAD + r"[+-]?[0-9]+")
_FLOAT = re.compile(_LEAD + r"[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)")
_HEX = re.compile(_LEAD + r"[+-]?0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*([pP][+-]?[0-9]+)?")
_TIME = r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]*))?)?Z?)?"
_TIME_PY = re.compile(_TIME)


def type_is_ordered(kind: LogicalType) -> bool:
    return kind not in (LogicalType.VECTOR, LogicalType.BOOL)


def type_supports_rmi(kind: LogicalType) -> bool:
    return kind in (LogicalType.INT64, LogicalType.DOUBLE, LogicalType.TIMESTAMP)


def _int64(text: str) -> int:
    if not _INT.fullmatch(text) or not -(1 << 63) <= (value := int(text)) < 1 << 63:
        raise ValueError(text)
    return value


def _timestamp(text: str) -> int:
    try:
        return _int64(text)
    except ValueError:
        pass
    m = _TIME_PY.fullmatch(text)
    if not m:
        raise ValueError(text)
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 23 and minute <= 59 and second <= 60):
        raise ValueError(text)
    # days beyond a month's end run on into the next month
    days = datetime.date(year, month, 1).toordinal() - EPOCH.toordinal() + day - 1 if year else _year_zero(month) + day - 1
    return ((days * 24 + hour) * 60 + minute) * 60_000 + second * 1000 + int(((m[7] or "") + "000")[:3])


def _year_zero(month: int) -> int:
    """Days from 1970 to the first of a month of the year 0, which was a leap year."""
    return datetime.date(4, month, 1).toordinal() - 1461 - EPOCH.toordinal()


def parse_value(kind: LogicalType, text: str):
    """The value that the text stands for; ValueError if it stands for none of this type."""
    kind = LogicalType(kind)
    try:
        if kind == LogicalType.INT64:
            return _int64(text)
        if kind == LogicalType.DOUBLE:
            if not (_FLOAT.fullmatch(text) or _HEX.fullmatch(text)):
                raise ValueError(text)
            value = float(text) if _FLOAT.fullmatch(text) else float.fromhex(text.strip())
            if not math.isfinite(value):
                raise ValueError(text)
            return value
        if kind == LogicalType.STRING:
            return text
        if kind == LogicalType.BOOL:
            return {"true": True, "1": True, "false": False, "0": False}[text.lower()]
        if kind == LogicalType.TIMESTAMP:
            return _timestamp(text)
    except (ValueError, KeyError, OverflowError):
        raise ValueError(f"{text!r} is no {kind.value}") from None
    raise ValueError("vectors have no text form")


def format_value(kind: LogicalType, value) -> str:
    """The text of a value; parse_value gives the value back."""
    kind = LogicalType(kind)
    if kind == LogicalType.DOUBLE:
        return "%.17g" % value
    if kind == LogicalType.BOOL:
        return "true" if value else "false"
    if kind == LogicalType.TIMESTAMP:
        day, ms = divmod(int(value), 86_400_000)
        at = EPOCH + datetime.timedelta(days=day, milliseconds=ms - ms % 1000)
        return f"{at.year:04d}-{at.month:02d}-{at.day:02d}T{at:%H:%M:%S}" + (f".{ms % 1000:03d}" if ms % 1000 else "") + "Z"
    if kind == LogicalType.VECTOR:
        raise ValueError("vectors have no text form")
    return str(value)


def parsed(column: Column, kind: LogicalType) -> Column:
    """A text column as values of the type; null where the text is null or stands for none."""
    kind = LogicalType(kind)
    if kind == LogicalType.STRING:
        return column
    if kind == LogicalType.BOOL:
        low = F.lower(column)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    bare = F.regexp_replace(column, "^" + _LEAD, "")
    whole = F.when(bare.rlike(r"^[+-]?[0-9]+\z"), bare.try_cast("bigint"))
    if kind == LogicalType.INT64:
        return whole
    if kind == LogicalType.DOUBLE:
        number = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), bare.try_cast("double"))
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if kind == LogicalType.TIMESTAMP:
        shape = "^" + _TIME + r"\z"
        part = lambda i: F.coalesce(F.regexp_extract(column, shape, i).try_cast("int"), F.lit(0))
        year, month, day, hour, minute, second = map(part, range(1, 7))
        fine = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
        days = F.date_diff(F.make_date(year, F.greatest(F.least(month, F.lit(12)), F.lit(1)), F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1
        ms = F.substring(F.concat(F.regexp_extract(column, shape, 7), F.lit("000")), 1, 3).try_cast("bigint")
        value = ((days.cast("bigint") * 24 + hour) * 60 + minute) * 60_000 + second * 1000 + ms
        return F.timestamp_millis(F.coalesce(whole, F.when(column.rlike(shape) & fine, value)))
    raise ValueError("vectors have no text form")


def is_valid(column: Column, kind: LogicalType) -> Column:
    """Whether a text column is null (absent) or stands for a value of the type."""
    return column.isNull() | parsed(column, kind).isNotNull()


def formatted(column: Column, kind: LogicalType) -> Column:
    """A column of values as text. Doubles are printed in Java's shortest form that reads back the same."""
    kind = LogicalType(kind)
    if kind == LogicalType.TIMESTAMP:
        ms = F.pmod(F.unix_millis(column), F.lit(1000))
        return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.when(ms > 0, F.format_string(".%03d", ms)).otherwise(""), F.lit("Z"))
    if kind == LogicalType.VECTOR:
        raise ValueError("vectors have no text form")
    return column.cast("string")


def literal(kind: LogicalType, value) -> Column:
    return F.timestamp_millis(F.lit(int(value))) if kind == LogicalType.TIMESTAMP else F.lit(value).cast(SPARK_TYPES[kind])


def check_literal(kind: LogicalType, value) -> None:
    """No coercion: an int is no double, a bool no int."""
    want = {LogicalType.INT64: int, LogicalType.DOUBLE: float, LogicalType.STRING: str, LogicalType.BOOL: bool, LogicalType.TIMESTAMP: int}.get(kind)
    if want is None or type(value) is not want:
        raise TypeError(f"a {kind.value} column can't be compared with {value!r}")


def prefix_upper_bound(prefix: str | bytes) -> bytes | None:
    """The least byte string above all that begin with the prefix; None if there is none."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    raw = raw.rstrip(b"\xff")
    return raw[:-1] + bytes([raw[-1] + 1]) if raw else None
