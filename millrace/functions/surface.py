"""User-supplied functions on the DataFrame surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One output row per input row, from column expressions."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def flat_map(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One output row per element of an array expression."""
    return df.select(F.explode(items).alias(name))


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def fold_left(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold the elements of an array column."""
    return F.aggregate(values, start, step)
