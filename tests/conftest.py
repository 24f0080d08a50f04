import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=2, memory="4g")
    session.conf.set("spark.sql.streaming.metricsEnabled", "false")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def drain(spark, tmp_path):
    """Write a DataFrame as several files, stream them one per micro-batch through an operator."""

    def run(df, operator, order="ts", files=3, mode="append", watermark=None, checkpoint=None, source=None):
        source = source or str(tmp_path / "in")
        if df is not None:
            from pyspark.sql import Window
            from pyspark.sql import functions as F

            cut = df.withColumn("__file", F.ntile(files).over(Window.orderBy(order)))
            for i in range(1, files + 1):
                cut.filter(F.col("__file") == i).drop("__file").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1)
        rows = stream.parquet(source)
        if watermark:
            rows = rows.withWatermark("ts", watermark)
        out = str(tmp_path / "out")
        query = (
            operator(rows)
            .writeStream.format("parquet" if mode == "append" else "memory")
            .outputMode(mode)
            .option("checkpointLocation", checkpoint or str(tmp_path / "checkpoint"))
            .option("path", out)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.read.parquet(out)

    return run


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(map(tuple, picked.collect()), key=repr)
