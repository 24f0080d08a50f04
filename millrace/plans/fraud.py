"""Trades against clusters of normal trades."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import nearest_centroid

PRICE_SCALE = 1000
CLUSTERS = 20


def trade_points(trades: DataFrame) -> DataFrame:
    """Trades as points: scaled price and volume."""
    return trades.withColumns(
        {"x": (F.col("trade_price") * PRICE_SCALE).cast("double"), "y": F.col("trade_vol").cast("double")}
    )


def nearest_cluster(trades: DataFrame, centroids: DataFrame, compat_linear_vol: bool = False) -> DataFrame:
    """The closest cluster of each trade."""
    found = nearest_centroid(trade_points(trades), centroids, compat_linear_vol=compat_linear_vol)
    return found.withColumnRenamed("centroid_id", "cluster").drop("x", "y")


def _fitted(trades: DataFrame, k: int, seed: int, max_iter: int):
    points = trade_points(trades.filter(F.col("trade_price").isNotNull() & F.col("trade_vol").isNotNull()))
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points)
    return vectors, KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(vectors.select("features"))


def _centers(spark: SparkSession, model) -> DataFrame:
    """The centers, one row each; there are ``k`` of them."""
    centers = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(centers, "id bigint, x double, y double")


def fit_clusters(trades: DataFrame, k: int = CLUSTERS, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """Cluster centers fitted to the trades, as (id, x, y)."""
    return _centers(trades.sparkSession, _fitted(trades, k, seed, max_iter)[1])


def settled(trades: DataFrame, k: int = CLUSTERS, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """Trades with the nearest fitted center, and whether the fitted model names one just as near."""
    vectors, model = _fitted(trades, k, seed, max_iter)
    centers = _centers(trades.sparkSession, model)
    told = model.transform(vectors).drop("features")
    # Centers at equal distance are equally right.
    named = told.join(F.broadcast(centers.select(F.col("id").alias("prediction"), F.col("x").alias("__cx"), F.col("y").alias("__cy"))), "prediction")
    far = (F.col("x") - F.col("__cx")) ** 2 + (F.col("y") - F.col("__cy")) ** 2
    found = nearest_centroid(named.withColumn("__told", far), centers)
    close = F.abs(F.col("__told") - F.col("distance")) <= 1e-9 * (1 + F.col("distance"))
    return found.withColumn("settled", close).withColumnRenamed("centroid_id", "cluster").select(
        *trades.columns, "cluster", "settled"
    )
