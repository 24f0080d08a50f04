"""Choosing partitions, repeating rows and measuring message delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import with_position


def mod_partition(df: DataFrame, ident: str, n: int, name: str = "partition") -> DataFrame:
    return df.withColumn(name, F.pmod(F.col(ident), F.lit(n)).cast("int"))


def repartition_by_mod(df: DataFrame, ident: str, n: int) -> DataFrame:
    """Row with id ``i`` goes to partition ``i mod n``."""
    return df.repartitionById(n, F.pmod(F.col(ident), F.lit(n)).cast("int"))


def partition_first_seen(
    df: DataFrame, key: str, sequence: str, n: int
) -> DataFrame:
    """Partition number of each key: its rank by first appearance, or key mod n once past ``n``."""
    first = df.groupBy(key).agg(F.min(sequence).alias("first_seen"))
    ranked = with_position(first, [], ["first_seen", key], "rank")
    number = F.col("rank") - 1
    return ranked.select(
        key,
        "first_seen",
        F.when(number >= n, F.pmod(F.col(key).cast("bigint"), F.lit(n))).otherwise(number).cast("int").alias("partition"),
    )


def repartition_round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def replay_repeat(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times."""
    return df.withColumn("replay", F.explode(F.sequence(F.lit(1), F.lit(n))))


def message_latency(df: DataFrame, received: str = "received", column: str = "value") -> DataFrame:
    """Milliseconds between the time in the first field and the receive time."""
    sent = F.get(F.split(column, ","), F.lit(0)).cast("bigint")
    return df.withColumn("latency_ms", F.unix_millis(received) - sent)
