"""Message topics in and out; the decoding is separate from the connector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_kv(messages: DataFrame) -> DataFrame:
    """Key and value as text, with the envelope columns that exist."""
    envelope = [c for c in ("topic", "partition", "offset", "timestamp") if c in messages.columns]
    return messages.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *envelope
    )


def decode_json(messages: DataFrame, schema: T.StructType, time_field: str | None = "dateTime") -> DataFrame:
    """Typed rows; ``time_field`` (epoch millis) also becomes the event time ``ts``."""
    rows = messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    if time_field and time_field in rows.columns:
        rows = rows.withColumn("ts", F.timestamp_millis(time_field))
    return rows


def page_view_country(views: DataFrame) -> DataFrame:
    """The country under either of its two field names."""
    return views.withColumn("country", F.coalesce("countryId", "country")).drop("countryId")


def encode_json(df: DataFrame, key: str | None = None) -> DataFrame:
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def encode_kv(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def write_keyed(orders: DataFrame) -> DataFrame:
    """Orders as messages keyed by their security."""
    return encode_json(orders, "sec_code")


#: Messages of a micro-batch, over all partitions: what keyed processors have to sort at once.
MAX_OFFSETS = 1_000_000


def topic_options(
    servers: str, topics: Sequence[str], start: str = "earliest", max_offsets: int = MAX_OFFSETS
) -> dict[str, str]:
    """Connector options; ``start`` is earliest, latest or a JSON of offsets.

    ``max_offsets`` bounds a micro-batch, so that a backlog is not one batch.
    """
    return {
        "maxOffsetsPerTrigger": str(max_offsets),
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": start,
        "failOnDataLoss": "true",
    }


def read_messages(
    spark: SparkSession, servers: str, topics: Sequence[str], start: str = "earliest", stream: bool = True
) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**topic_options(servers, topics, start)).load()


def read_kafka_json(
    spark: SparkSession, servers: str, topics: Sequence[str], schema: T.StructType, start: str = "earliest"
) -> DataFrame:
    return decode_json(read_messages(spark, servers, topics, start), schema)


def read_kafka_kv(spark: SparkSession, servers: str, topics: Sequence[str], start: str = "earliest") -> DataFrame:
    return decode_kv(read_messages(spark, servers, topics, start))


def _sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return (
        df.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def write_kafka_json(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    return _sink(encode_json(df, key), servers, topic, checkpoint)


def write_kafka_kv(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "key", value: str = "value"):
    return _sink(encode_kv(df, key, value), servers, topic, checkpoint)
