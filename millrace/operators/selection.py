"""Order statistics, sorted output and price levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.bounded import broadcast_if_small
from millrace.operators.ordered import BUCKET, cut, null_safe_join, running_totals


def select_kth(
    df: DataFrame, keys: Sequence[str], score: str, k: int, tie: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """The row with the k-th smallest score (from 0) of each key.

    Rows of one score are in the order of ``tie`` and then of a hash of the row. A key with more than
    ``rows`` rows is cut along that order; counts per bucket tell which one holds the answer, and only
    its rows are looked at. Rows that are alike are counted before they are shuffled.
    """
    named = df.withColumn("__hash", F.xxhash64(*df.columns))
    order = [score, *tie, "__hash"]
    bucketed, several = cut(named, keys, order, rows)
    along = Window.partitionBy(*keys).orderBy(*order)
    if not several:
        return bucketed.withColumn("__no", F.row_number().over(along)).filter(F.col("__no") == k + 1).select(*df.columns)
    counts = bucketed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(BUCKET))
    wanted = (
        counts.withColumn("__upto", upto)
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .filter((F.col("__before") <= k) & (F.col("__upto") > k))
    )
    wanted = wanted.select(*keys, BUCKET, "__before")
    inside = null_safe_join(bucketed, broadcast_if_small(wanted), [*keys, BUCKET]).select(
        *dict.fromkeys([*keys, *order]), F.struct(*df.columns).alias("__row"), "__before"
    )
    alike = inside.groupBy(*dict.fromkeys([*keys, *order])).agg(
        F.first("__row").alias("__row"), F.first("__before").alias("__before"), F.count(F.lit(1)).alias("__n")
    )
    so_far = F.col("__before") + F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return (
        alike.withColumn("__last", so_far)
        .filter((F.col("__last") > k) & (F.col("__last") - F.col("__n") <= k))
        .select("__row.*")
    )


def secondary_sort(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows of a key next to each other and in order, keys in order.

    Range partitions: a key too large for one runs on into the next. Where a key must not be
    split, ``co_partition`` places it by the key alone.
    """
    columns = [F.col(c) for c in (key, *order)]
    placed = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return placed.sortWithinPartitions(key, *order)


def price_levels(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Open volume and order count per price with its rank: best buy highest, best sell lowest."""
    levels = orders.groupBy(*keys, "trade_dir", "order_price").agg(
        F.sum("order_vol").cast("bigint").alias("volume"), F.count(F.lit(1)).alias("orders")
    )
    best_first = F.when(F.col("trade_dir") == "B", -F.col("order_price")).otherwise(F.col("order_price"))
    ranked = levels.withColumn("__sort", best_first)
    placed = running_totals(
        ranked, [*keys, "trade_dir"], ["__sort"], {"level": F.lit(1).cast("bigint")}
    )
    return placed.drop("__sort")


def top_of_book(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Best bid, best ask and whether they cross."""
    price = F.col("order_price")
    best = orders.groupBy(*keys).agg(
        F.max(F.when(F.col("trade_dir") == "B", price)).alias("best_bid"),
        F.min(F.when(F.col("trade_dir") == "S", price)).alias("best_ask"),
    )
    return best.withColumn("crossed", F.coalesce(F.col("best_ask") <= F.col("best_bid"), F.lit(False)))


def sort_levels_desc(levels: DataFrame, price: Column | str = "order_price") -> DataFrame:
    """Price levels from the highest price down (a range-partitioned sort)."""
    column = F.col(price) if isinstance(price, str) else price
    return levels.orderBy(column.desc())
