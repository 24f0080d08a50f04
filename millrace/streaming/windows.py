"""Event-time windows; the same functions run on tables and on streams.

A stream needs ``withWatermark`` before these; a window is final once the watermark passes it
and a row older than that is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import BUCKET, cut


def _span(seconds: float) -> str:
    return f"{int(seconds * 1_000_000)} microseconds"


def tumbling_count(df: DataFrame, key: str, seconds: float = 60.0, ts: str = "ts") -> DataFrame:
    """Rows per key and window."""
    pane = F.window(ts, _span(seconds))
    counted = df.groupBy(pane.alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "count"
    )


def windowed_word_count(lines: DataFrame, seconds: float = 5.0, column: str = "line", pattern: str = " ") -> DataFrame:
    from millrace.operators.aggregates import explode_words

    return tumbling_count(explode_words(lines.select(column, "ts"), column, pattern), "word", seconds)


def session_count(df: DataFrame, key: str, gap: float = 60.0, ts: str = "ts", rows: int | None = None) -> DataFrame:
    """Rows per session of a key; a session ends when more than ``gap`` seconds pass.

    A stream uses ``session_window``. A table is shuffled once, by key and, where a key has more than
    ``rows`` rows, its bucket: sessions are formed inside each bucket, and only the first and last of a
    bucket can go on in a neighbour, so only these are put in order per key.
    """
    if df.isStreaming:
        pane = F.session_window(ts, _span(gap))
        counted = df.groupBy(pane.alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
        return counted.select(
            F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "count"
        )
    limit = int(gap * 1_000_000)
    bucketed, several = cut(df.select(key, F.unix_micros(ts).alias("__at")), [key], ["__at"], rows)
    scope = [key, BUCKET]
    along = Window.partitionBy(*scope).orderBy("__at")
    opens = (F.col("__at") - F.lag("__at").over(along) > limit).cast("int")
    local = (
        bucketed.withColumn("__opens", F.coalesce(opens, F.lit(0)))
        .withColumn("__no", F.sum("__opens").over(along))
        .groupBy(*scope, "__no")
        .agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count(F.lit(1)).alias("count"))
    )
    columns = [key, "__first", "__last", "count"]
    if not several:
        return _sessions(local.select(*columns), key, limit)
    edge = (F.col("__no") == 0) | (F.col("__no") == F.max("__no").over(Window.partitionBy(*scope)))
    local = local.withColumn("__edge", edge).drop("__no")
    # At most two rows per key and bucket.
    chain = Window.partitionBy(key).orderBy("__first")
    starts = (F.col("__first") - F.lag("__last").over(chain) > limit).cast("int")
    joined = (
        local.filter("__edge")
        .withColumn("__starts", F.coalesce(starts, F.lit(0)))
        .withColumn("__no", F.sum("__starts").over(chain))
        .groupBy(key, "__no")
        .agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("count").alias("count"))
    )
    return _sessions(local.filter("NOT __edge").select(*columns).unionByName(joined.select(*columns)), key, limit)


def _sessions(found: DataFrame, key: str, limit: int) -> DataFrame:
    return found.select(
        F.timestamp_micros("__first").alias("session_start"),
        F.timestamp_micros(F.col("__last") + limit).alias("session_end"),
        key,
        "count",
    )


def windowed_word_sessions(
    lines: DataFrame, gap: float = 5.0, column: str = "line", pattern: str = " "
) -> DataFrame:
    from millrace.operators.aggregates import explode_words

    return session_count(explode_words(lines.select(column, "ts"), column, pattern), "word", gap)
