"""Readers of executor and controller log lines (columns ``line_no`` and ``value``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordered import previous_row, with_position
from millrace.session import shared_path

RATE_SCALE = 1000.0
MAX_DELAY = 1_000_000.0


def read_log_lines(spark: SparkSession, path: str, container: str = r"([^/]+)$") -> DataFrame:
    """Lines of log files; the first group of ``container`` on a file's path names the executor.

    ``line_no`` counts an executor's lines from 0: its files by name, in a file the blocks by where they
    start, in a block the lines as they are read. That order is read once and stored, so it is the same
    for everything that follows.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    numbered = lines.select(
        F.regexp_extract(F.col("_metadata.file_path"), container, 1).alias("container"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("read"),
        "value",
    )
    stored = shared_path(spark, "log-lines")
    numbered.write.parquet(stored)
    placed = with_position(spark.read.schema(numbered.schema).parquet(stored), ["container"], ["file", "block", "read"], "n")
    return placed.select("container", (F.col("n") - 1).alias("line_no"), "value")


def _word(i: int) -> Column:
    return F.get("__w", F.lit(i))


def _number(i: int) -> Column:
    return _word(i).try_cast("bigint")


# How the lines of interest start, and what they are called here.
EXECUTOR_LINE = r"^(GT:|container start at|Starting run|Entering|Shutdown|Shutting) "
EXECUTOR_KINDS = {
    "GT:": "gt",
    "container": "host",
    "Starting": "restore",
    "Entering": "enter",
    "Shutdown": "shutdown",
    "Shutting": "shutting",
}


def parse_executor_log(lines: DataFrame) -> DataFrame:
    """Ground-truth and lifecycle lines as typed rows; other lines are dropped.

    The filter is on the raw text, so it runs before any line is split.
    """
    words = lines.filter(F.col("value").rlike(EXECUTOR_LINE)).withColumn("__w", F.split(F.rtrim("value"), " "))
    names = F.create_map(*[F.lit(x) for pair in EXECUTOR_KINDS.items() for x in pair])
    gt = F.col("kind") == "gt"
    when = (
        F.when(gt, _number(1))
        .when(F.col("kind") == "shutdown", _number(2))
        .when(F.col("kind").isin("restore", "enter", "shutting"), _number(3))
    )
    typed = words.withColumn("kind", F.element_at(names, _word(0)))
    return typed.select(
        "container",
        "line_no",
        "kind",
        when.alias("ts_ms"),
        F.when(gt, _number(3)).cast("int").alias("substream"),
        F.when(gt, _number(5)).alias("n"),
        F.when(gt, _number(7)).alias("latency_ms"),
        F.when(F.col("kind") == "host", _word(3)).alias("host"),
    )


def parse_delay_log(lines: DataFrame) -> DataFrame:
    """Rows (container, partition, delay, time) of ``Partition p,delay,time`` lines; others are dropped."""
    fields = F.split(F.get(F.split(F.rtrim("value"), " "), F.lit(1)), ",")
    rows = lines.filter(F.col("value").startswith("Partition ")).withColumn("__f", fields).filter(F.size("__f") >= 3)
    return rows.select(
        "container",
        F.get("__f", F.lit(0)).alias("partition"),
        F.get("__f", F.lit(1)).try_cast("double").alias("delay"),
        F.get("__f", F.lit(2)).try_cast("bigint").alias("time"),
    )


def parse_controller_log(lines: DataFrame) -> DataFrame:
    """Model lines as (time since the first model line, metric, container, value)."""
    words = lines.withColumn("__w", F.split(F.rtrim("value"), " ")).filter(
        _word(0).isin("Model,", "DelayEstimateModel,")
    )
    pair = F.concat_ws(" ", _word(4), _word(5))
    metric = (
        F.when(pair == "Arrival Rate:", "arrival_rate")
        .when(pair == "Service Rate:", "service_rate")
        .when(pair == "Instantaneous Delay:", "window_delay")
        .when(pair == "Longterm Delay:", "longterm_delay")
    )
    typed = words.select("line_no", _number(2).alias("at"), metric.alias("metric"), "value").filter(
        F.col("metric").isNotNull()
    )
    # One row; a scalar subquery in the plan.
    begin = typed.agg(F.min_by("at", "line_no")).scalar()
    inner = F.regexp_replace(F.regexp_extract("value", r"\{(.*)\}", 1), " ", "")
    entries = typed.withColumn("e", F.explode(F.split(inner, ","))).filter(F.col("e") != "")
    text = F.split_part("e", F.lit("="), F.lit(2))
    rate = F.col("metric").isin("arrival_rate", "service_rate")
    number = F.when(rate & (text == "NaN"), 0.0).otherwise(text.try_cast("double"))
    value = (
        F.when(rate, number * RATE_SCALE)
        .when(F.col("metric") == "longterm_delay", F.least(F.greatest(number, F.lit(0.0)), F.lit(MAX_DELAY)))
        .otherwise(number)
    )
    return entries.select(
        "line_no",
        (F.col("at") - begin).alias("time"),
        "metric",
        F.split_part("e", F.lit("="), F.lit(1)).alias("container"),
        value.alias("value"),
    )


def parse_migration_log(
    lines: DataFrame, severe_time: bool = True
) -> DataFrame:
    """Decisions, finished deployments and severe counts.

    ``kind`` is decision, deployment or severe; ``action`` is in, out or balance. A severe count
    has no time of its own and takes that of the line before it; without ``severe_time`` it gets
    none, and no line has to be brought together with another.
    """
    seen = lines.select("line_no", "value")
    if severe_time:
        seen = previous_row(seen, [], ["line_no"], {"value": "__above"})
    else:
        seen = seen.withColumn("__above", F.lit(None).cast("string"))
    of_interest = F.col("value").rlike(r"^(Migration!|Executors stopped|Number \S+ severe) ")
    words = seen.filter(of_interest).withColumn("__w", F.split(F.rtrim("value"), " "))
    decision, stopped = _word(0) == "Migration!", (_word(0) == "Executors") & (_word(1) == "stopped")
    severe = (_word(0) == "Number") & (_word(2) == "severe")
    kind = F.when(decision, "decision").when(stopped, "deployment").when(severe, "severe")
    scale = (
        F.when(decision & (_word(1) == "Scale"), _word(2))
        .when(decision, "balance")
        .when(stopped & (_word(6) == "scale-in"), "in")
        .when(stopped & (_word(6) == "scale-out"), "out")
        .when(stopped, "balance")
    )
    action = F.when(F.col("__scale").isin("in", "out"), F.col("__scale")).when(
        F.col("__scale").isNotNull(), "balance"
    )
    at = (
        F.when(decision, F.regexp_extract("value", r"time: (\d+)", 1))
        .when(stopped, _word(4))
        .when(severe, F.get(F.split("__above", " "), F.lit(2)))
        .try_cast("bigint")
    )
    source = F.nullif(F.regexp_extract("value", r" from (\S+)", 1), F.lit(""))
    target = F.nullif(F.regexp_extract("value", r" to (\S+)", 1), F.lit(""))
    return (
        words.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("__scale", scale)
        .select(
            "line_no",
            "kind",
            at.alias("time"),
            action.alias("action"),
            source.alias("source"),
            target.alias("target"),
            F.when(F.col("kind") == "severe", _number(4)).alias("severe"),
        )
    )
