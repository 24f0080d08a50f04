"""Running and sliding values per key, in their table form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.medians import seasonal_median, sliding_median  # noqa: F401
from millrace.operators.ordered import cut, null_safe_join, running_totals, totals_of


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int | None = None
) -> DataFrame:
    """Add running sum, count and average of ``value``."""
    totals = {"running_sum": F.col(value), "running_count": F.lit(1).cast("bigint")}
    out = running_totals(df, keys, order, totals, rows)
    return out.withColumn("running_avg", F.col("running_sum") / F.col("running_count"))


def running_price_sum(trades: DataFrame, tie: str = "trade_no") -> DataFrame:
    """Prices added up per security, with their count and average."""
    return running_sum(trades, ["sec_code"], ["ts", tie], "trade_price")


def running_volume(trades: DataFrame, tie: str = "trade_no") -> DataFrame:
    """Volume added up per security."""
    return running_totals(trades, ["sec_code"], ["ts", tie], {"running_volume": F.col("trade_vol")})


#: Powers of the decay within a block stay within this and its inverse.
_LARGEST_POWER = 1e100


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    age: float = 30.0,
    warmup: int = 10,
    rows: int | None = None,
) -> DataFrame:
    """Exponentially weighted average with decay 2/(age+1); returns keys, order, value, ``ewma``.

    It is 0 for the first ``warmup`` rows of a key, starts as their mean at the next row, and takes up
    each later value. The recursion is linear: a row's level is the sum of what each row before it adds,
    times the decay to the power of the rows between. Rows are numbered; inside a block of rows the level
    is a prefix sum of values divided by powers of the decay, times the power of the row. The block before
    adds its last level, the one before that ``1e-100`` of its own; older blocks add nothing to a double.
    A missing value spoils the average from there on, as in any sum with it.
    """
    decay = 2.0 / (age + 1.0)
    keep, lead = 1.0 - decay, warmup + 1
    if not 0 <= keep < 1:
        raise ValueError("age must be at least 1")
    # With no memory at all a level is the value itself: any base would do, all its powers but the first are 0.
    span = lead if keep == 0 else max(lead, int(-math.log(_LARGEST_POWER) / math.log(keep)))
    columns = list(dict.fromkeys([*keys, *order, value]))
    number = F.col(value).cast("double")
    held = df.select(*columns).withColumn(value, F.coalesce(number, F.lit(float("nan"))))
    bad = F.isnan(value)
    bucketed, several = cut(held, keys, order, rows)
    totals = {"__at": F.lit(1).cast("bigint"), "__bad": bad.cast("bigint")}
    placed = totals_of(bucketed, several, keys, order, totals)
    placed = placed.withColumn("__block", F.floor((F.col("__at") - 1) / span))
    at = F.col("__at")
    clean = F.when(bad, 0.0).otherwise(F.col(value))

    def power(exponent):
        return F.when(exponent == 0, 1.0).otherwise(F.pow(F.lit(keep), exponent))

    if keep == 0:
        mean = F.sum(clean / warmup).over(Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(-warmup, -1))
        level = F.when(at == lead, mean).otherwise(clean)
        return _spoiled(placed.withColumn("__level", level), columns, value, lead)

    begin = F.col("__block") * span + 1
    # The first rows count together at the row after them; that row's own value is not taken up.
    adds = F.when(at <= warmup, clean / warmup).when(at == lead, F.lit(0.0)).otherwise(decay * clean)
    since = F.greatest(at, F.lit(lead)) - begin
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(adds / power(since)).over(inside)
    placed = placed.withColumn("__own", own)

    last = F.when(at % span == 0, F.col("__own") * power(F.lit(span - 1)))
    if several:
        # One row a block: what it hands to the next and to the one after.
        ends = placed.where(at % span == 0).select(*keys, "__block", last.alias("__last"))
        hands = F.explode(
            F.array(
                F.struct((F.col("__block") + 1).alias("__to"), F.col("__last"), F.lit(0.0).alias("__older")),
                F.struct((F.col("__block") + 2).alias("__to"), F.lit(0.0).alias("__last"), F.col("__last").alias("__older")),
            )
        )
        handed = ends.select(*keys, hands.alias("h")).groupBy(*keys, F.col("h.__to").alias("__block"))
        handed = handed.agg(F.sum("h.__last").alias("__last"), F.sum("h.__older").alias("__older"))
        placed = null_safe_join(placed, handed, [*keys, "__block"], "left")
    else:
        along = Window.partitionBy(*keys).orderBy("__block")
        placed = placed.withColumn("__end", last)
        for name, back in (("__last", 1), ("__older", 2)):
            placed = placed.withColumn(name, F.sum("__end").over(along.rangeBetween(-back, -back)))
    carried = F.coalesce("__last", F.lit(0.0)) + F.coalesce("__older", F.lit(0.0)) * power(F.lit(span))
    level = power(at - begin) * F.col("__own") + power(at - begin + 1) * carried
    return _spoiled(placed.withColumn("__level", level), columns, value, lead)


def _spoiled(levels: DataFrame, columns: Sequence[str], value: str, lead: int) -> DataFrame:
    shown = F.when(F.col("__at") < lead, 0.0).when(F.col("__bad") > 0, F.lit(float("nan"))).otherwise(F.col("__level"))
    return levels.select(*columns, shown.alias("ewma"))


def sliding_avg(
    df: DataFrame, keys: Sequence[str], millis: str, value: str, window_ms: int = 2000, slot_factor: int = 30
) -> DataFrame:
    """Mean over the trailing ``window_ms`` up to and including each row's time.

    Rows are first summed per (key, millisecond); a time slot gets copies of the sums that lie
    within ``window_ms`` before it, so a key is cut into slots of ``slot_factor`` windows.
    """
    slot_ms = window_ms * slot_factor
    per_time = df.groupBy(*keys, millis).agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    first = F.floor(F.col(millis) / slot_ms)
    last = F.floor((F.col(millis) + window_ms) / slot_ms)
    copies = per_time.withColumn("__slot", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "__slot").orderBy(millis).rangeBetween(-window_ms, 0)
    means = copies.withColumn("avg_value", F.sum("__sum").over(w) / F.sum("__n").over(w)).filter(
        F.col("__slot") == first
    )
    return means.select(*keys, millis, "avg_value")


def auction_phase(orders: DataFrame, time_number: Column, opening: int = 92500) -> DataFrame:
    """Call auction before the opening time, continuous trading from it on."""
    return orders.withColumn("phase", F.when(time_number < opening, "call").otherwise("continuous"))
