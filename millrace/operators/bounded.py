"""Size checks for data that is sent to every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimiser estimates it; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where the plan statistics bound the size in bytes.

    Where they do not (an aggregate, whose estimate is that of its input), the join is left to
    adaptive execution, which decides by the bytes that the side really has.
    """
    if df.isStreaming:
        return df
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


def in_any_interval(value: Column, intervals: list[tuple[float, float]]) -> Column:
    """True when ``value`` lies in one of a short literal list of closed intervals."""
    hit = F.lit(False)
    for low, high in intervals:
        hit = hit | value.between(low, high)
    return hit
