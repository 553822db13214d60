"""Columns that an operator adds for its own use must not meet those that the rows carry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(df with all columns but `names` under numbers, a function that gives them their names and order again and
    leaves out what was added, but for the columns it is told)."""
    hidden = {c: c if c in names else f"__c{i}" for i, c in enumerate(df.columns)}
    inside = df.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    return inside, lambda out, *added: out.select(*(F.col(h).alias(c) for c, h in hidden.items()), *added)
