"""Running queries with a checkpoint, and their throughput per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def checkpointed(
    df: DataFrame,
    checkpoint: str,
    sink: str = "memory",
    name: str | None = None,
    mode: str = "append",
    path: str | None = None,
    once: bool = True,
    interval: str = "1 second",
) -> StreamingQuery:
    """Start a query that resumes from ``checkpoint``; ``once`` drains what is there and stops."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if path:
        writer = writer.option("path", path)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Count rows, and any further aggregates, as they pass this point of the plan."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


RECORD = "query string, batch bigint, stage string, rows bigint, rows_per_second double"


class ThroughputListener(StreamingQueryListener):
    """Appends one small record per stage and micro-batch to the table at ``path``; none is dropped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.records = spark, path, 0

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        rows = [(p.name, p.batchId, "input", p.numInputRows, p.processedRowsPerSecond)]
        rows += [(p.name, p.batchId, f"state_{i}", s.numRowsUpdated, None) for i, s in enumerate(p.stateOperators)]
        rows += [(p.name, p.batchId, stage, row["rows"], None) for stage, row in p.observedMetrics.items()]
        self.spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(self.path)
        self.records += len(rows)


def stage_throughput(spark: SparkSession, path: str) -> DataFrame:
    """All records that listeners have appended to ``path``."""
    return spark.read.schema(RECORD).parquet(path)
