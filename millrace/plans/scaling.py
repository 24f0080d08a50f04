"""Report over controller and migration logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import running_totals



def total_arrival_rate(model: DataFrame) -> DataFrame:
    """Arrival rate of all containers per tick."""
    return model.filter(F.col("metric") == "arrival_rate").groupBy("time").agg(F.sum("value").alias("total_rate"))


def worst_delay(model: DataFrame) -> DataFrame:
    """Largest window delay of any container per tick."""
    return model.filter(F.col("metric") == "window_delay").groupBy("time").agg(F.max("value").alias("worst_delay"))


def decision_counts(migrations: DataFrame, low: float, high: float) -> DataFrame:
    """Scale-in, scale-out and balance decisions inside the interval."""
    chosen = migrations.filter((F.col("kind") == "decision") & F.col("time").between(low, high))
    return chosen.groupBy("action").agg(F.count(F.lit(1)).alias("count"))


def _steps(migrations: DataFrame) -> DataFrame:
    change = F.when(F.col("action") == "in", -1).when(F.col("action") == "out", 1)
    done = migrations.filter((F.col("kind") == "deployment") & F.col("action").isin("in", "out"))
    return done.select("line_no", "time", change.cast("bigint").alias("change"))


def executor_count_steps(migrations: DataFrame, initial: int) -> DataFrame:
    """Number of executors before and after each finished scale-in or scale-out."""
    placed = running_totals(_steps(migrations), [], ["line_no"], {"__sum": F.col("change")})
    after = F.lit(initial) + F.col("__sum")
    return placed.select(
        "line_no", "time", (after - F.col("change")).alias("executors_before"), after.alias("executors_after")
    )


def _mean_executors(change: Column, initial: int, low: float, high: float, last: float) -> Column:
    end = min(high, last)
    share = change * F.greatest(F.lit(0.0), F.lit(float(end)) - F.greatest(F.col("time"), F.lit(low)))
    total = F.lit(initial * max(0.0, end - low)) + F.coalesce(F.sum(share), F.lit(0.0))
    return total / F.lit(float(high - low))


def avg_executors(migrations: DataFrame, initial: int, low: float, high: float, last: float) -> DataFrame:
    """Time-weighted mean number of executors in [low, high], known up to ``last``.

    Each step counts from its time to the end, so the mean is one sum and needs no order.
    """
    mean = _mean_executors(F.col("change"), initial, low, high, last)
    return _steps(migrations).agg(mean.alias("avg_executors"))


ACTIONS = ("in", "out", "balance")


def scaling_report(
    model: DataFrame, migrations: DataFrame, initial: int, low: float, high: float, last: float
) -> DataFrame:
    """Single figures as (item, value): mean executors, decisions, peak rate and worst delay.

    Each log is read once; an action that never occurred has no row.
    """
    change = F.when(F.col("action") == "in", -1).when(F.col("action") == "out", 1)
    moved = F.when((F.col("kind") == "deployment") & change.isNotNull(), change)
    chosen = (F.col("kind") == "decision") & F.col("time").between(low, high)
    figures = migrations.agg(
        _mean_executors(moved, initial, low, high, last).alias("avg_executors"),
        *[
            F.nullif(F.sum((chosen & (F.col("action") == a)).cast("bigint")), F.lit(0)).alias(f"decisions_{a}")
            for a in ACTIONS
        ],
        F.max(F.when(F.col("kind") == "severe", F.col("severe"))).alias("max_severe"),
    )
    ticks = model.groupBy("time").agg(
        F.sum(F.when(F.col("metric") == "arrival_rate", F.col("value"))).alias("rate"),
        F.max(F.when(F.col("metric") == "window_delay", F.col("value"))).alias("delay"),
    )
    peaks = ticks.agg(F.max("rate").alias("peak_arrival_rate"), F.max("delay").alias("worst_delay"))

    def unpivot(df: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns]
        )
        return df.select(F.explode(pairs).alias("p")).select("p.item", "p.value").filter("value IS NOT NULL")

    return unpivot(figures).unionByName(unpivot(peaks))
