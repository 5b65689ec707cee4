"""Structs inside lambdas, and values that are computed once and used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record(**fields: Column) -> Column:
    """Struct that keeps its field names inside lambda functions, where aliases are lost."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimiser will not copy into the filters and projections above it.

    A filter on a plain projected column is pushed below the projection with the whole expression in it, which
    parses a document once for the filter and again for the column. Nothing is pushed through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
