"""Distribution statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY_SIGMA = 0.000001


def mean_stat(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(value).alias("count"), F.avg(value).alias("mean")
    )


def _bin(value: Column, bin_width: int) -> Column:
    """Whole-number division that cuts toward zero."""
    return (value.cast("bigint") / F.lit(bin_width)).cast("bigint")


def histogram(
    df: DataFrame, keys: Sequence[str], value: str, bin_width: int, weight: Column | None = None
) -> DataFrame:
    """Weighted count per bin, with the truncated mean of the whole key on every row."""
    w = weight if weight is not None else F.lit(1)
    scope = [*keys, "__all"]  # the constant makes an empty key list one group
    bins = (
        df.withColumn("__all", F.lit(1))
        .groupBy(*scope, _bin(F.col(value), bin_width).alias("bin"))
        .agg(F.sum(w).cast("bigint").alias("count"), F.sum(F.col(value) * w).alias("weighted"))
    )
    # Over the small bin table: no second read, and a null key keeps its bins.
    whole = Window.partitionBy(*scope)
    joined = bins.withColumns(
        {"all_count": F.sum("count").over(whole), "all_weighted": F.sum("weighted").over(whole)}
    )
    mean = (F.col("all_weighted") / F.col("all_count")).cast("bigint")
    return joined.select(*keys, "bin", "count", mean.alias("mean"), F.col("all_count").alias("total"))


def histogram_confidence(bins: DataFrame, keys: Sequence[str], bin_width: int, percent: int) -> DataFrame:
    """Bounds reached by growing from the mean bin, one bin on each side at a time.

    Growth stops when the count inside is at least ``percent`` of all or every bin is inside;
    it takes at least one step unless the mean bin is the only one.
    """
    mean_bin = _bin(F.col("mean"), bin_width)
    rings = (
        bins.withColumn("mean_bin", mean_bin)
        .withColumn("ring", F.abs(F.col("bin") - F.col("mean_bin")))
        .groupBy(*keys, "mean_bin", "total", "ring")
        .agg(F.sum("count").alias("count"))
    )
    w = Window.partitionBy(*keys).orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.floor(F.col("total") * percent / 100)
    reach = rings.withColumn("inside", F.sum("count").over(w)).groupBy(*keys, "mean_bin", "total").agg(
        F.max("ring").alias("last_ring"),
        F.min(F.when((F.col("inside") >= limit) & (F.col("ring") >= 1), F.col("ring"))).alias("first_ok"),
        F.min(F.when(F.col("inside") >= limit, F.col("ring"))).alias("first_any"),
    )
    # When the mean bin alone is enough, the first step outwards already satisfies the limit.
    at_once = (F.col("last_ring") == 0) | (F.col("first_any") == 0) | (limit <= 0)
    steps = F.when(at_once, 1).otherwise(F.col("first_ok"))
    half = 0.5 if bin_width > 1 else 0.0
    return reach.withColumn("steps", steps).select(
        *keys,
        ((F.col("mean_bin") - F.col("steps") + half) * bin_width).cast("bigint").alias("lower"),
        ((F.col("mean_bin") + F.col("steps") + half) * bin_width).cast("bigint").alias("upper"),
    )


def entropy_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shannon entropy in bits; from count and sum of n log n, so one small row per value is shuffled."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n"))).alias("n_log_n")
    )
    return total.select(
        *keys, (F.log2(F.col("total")) - F.col("n_log_n") / F.col("total")).alias("entropy")
    )


def _sigma(value: str) -> Column:
    return F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0))


def entropy_normal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Differential entropy of a normal law with the sample deviation."""
    fitted = df.groupBy(*keys).agg(_sigma(value).alias("sigma"))
    safe = F.when(F.col("sigma") == 0, TINY_SIGMA).otherwise(F.col("sigma"))
    return fitted.select(*keys, (0.5 * F.log(2 * F.pi() * F.e() * safe * safe)).alias("entropy"))


def mle_normal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation; an empty input gives zeros."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mu"), _sigma(value).alias("sigma"), F.count(value).alias("n")
    )


def outlier_fraction(df: DataFrame, member: str, is_outlier: Column) -> DataFrame:
    """Distinct outliers over distinct members, from one row per member."""
    members = df.groupBy(member).agg(F.max(is_outlier.cast("int")).alias("out"))
    return members.agg(
        F.sum("out").cast("bigint").alias("outliers"),
        F.count(F.lit(1)).alias("members"),
        (F.sum("out") / F.count(F.lit(1))).alias("fraction"),
    )


def centroid_mean(centroids: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Mean of the centroids in whole numbers, cut toward zero."""
    n = F.count(F.lit(1))
    return centroids.agg(
        (F.sum(F.col(x).cast("bigint")) / n).cast("bigint").alias("mean_x"),
        (F.sum(F.col(y).cast("bigint")) / n).cast("bigint").alias("mean_y"),
    )
