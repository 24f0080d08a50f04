"""Helpers shared by the operators: Arrow batch maps, the shared folder, connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.session import checkpoint_dir, cut_lineage

# Lower-casing of A-Z alone, on UTF-8 bytes. bytes.split() then parts words at [\x20\x09-\x0D]+.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def map_columns(
    df: DataFrame,
    columns: Sequence[str],
    step: Callable[..., dict],
    schema: str,
    tool: Callable[[], object] | None = None,
) -> DataFrame:
    """Run ``step(tool, *lists)`` on Arrow batches of ``columns``; it returns one list per output column.

    Rows are independent of one another, so a lost task is simply run again.
    """
    columns = list(columns)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa

        made = tool() if tool else None
        for batch in batches:
            out = step(made, *[batch.column(c).to_pylist() for c in columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.select(*columns).mapInArrow(run, schema)


def kept_in_process(kind: str, name: object, make: Callable[[], object]) -> object:
    """An object built once per Python process and reused by later tasks; of each kind only the newest is held."""
    cache = sys.__dict__.setdefault("_millrace_llm_cache", {})
    held = cache.get(kind)
    if held is None or held[0] != name:
        # The old one goes before the new one is made.
        cache.pop(kind, None)
        held = cache[kind] = (name, make())
    return held[1]


def let_go(kind: str) -> None:
    """Drop what ``kept_in_process`` holds of a kind."""
    sys.__dict__.get("_millrace_llm_cache", {}).pop(kind, None)


def _scratch(sc) -> str:
    """A folder of this application in the checkpoint folder; it is removed when the driver ends."""
    base = f"{sc.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return base


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's checkpoint folder, kept until the driver ends."""
    checkpoint_dir(spark)
    sc = spark.sparkContext
    base = kept_in_process("scratch", sc.applicationId, lambda: _scratch(sc))
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, kept if executors go."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, rows: int, salt: int) -> DataFrame:
    """About ``rows`` rows of ``df`` chosen by a hash of doc_id; all of them if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node it reaches.

    Alternates two star contractions until no link changes; each round is two aggregations and
    two joins over the links, and its result goes to the reliable checkpoint folder. The driver
    sees one count and one checksum a round. Large stars are split by adaptive execution.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def smallest(near: DataFrame) -> DataFrame:
        return near.groupBy("a").agg(F.min("b").alias("m"))

    # Every link points from the larger to the smaller node.
    links = tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    links = cut_lineage(links)
    before = state(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = smallest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after_links = tidy(small.unionByName(low.select("a", F.col("m").alias("b"))))
        links = cut_lineage(after_links)
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
