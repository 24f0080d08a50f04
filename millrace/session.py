"""Session settings shared by the entry points, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings that may be changed on a running session; none of them is tied to local mode.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions are merged inside each partition before the exchange.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Keyed state lives in RocksDB and only its change log is uploaded per batch.
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; only a single-machine session may go without."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_SCRATCH: dict[str, str] = {}


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new path in a folder of this application in the shared checkpoint folder; removed when the driver ends."""
    checkpoint_dir(spark)
    sc = spark.sparkContext
    base = _SCRATCH.get(sc.applicationId)
    if base is None:
        base = _SCRATCH[sc.applicationId] = f"{sc.getCheckpointDir().rstrip('/')}/paths-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder so that lost executors do not lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
