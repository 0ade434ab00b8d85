"""Session helpers.

Library functions never create a session; they take the caller's. ``local_session`` exists
for tests and the bench only. ``checkpoint_dir`` reads the cluster's shared checkpoint folder
from the session and sets one only when none is configured (local runs).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyframe") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir`` (or set on the context). Where the
    session names none, a temporary folder is made for a ``local`` master only: on a cluster
    every executor would write to its own disk, so that is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        app = sc.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
        configured = _LOCAL_DIRS[app]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder, for a written intermediate table. The
    name holds the application id and a UUID, so two applications never share one."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tallyframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage", compression: str | None = None):
    """Write ``df`` once as parquet under the shared checkpoint folder and return a DataFrame
    reading it back. This cuts the lineage (a lost executor recomputes from the written
    files, not from the source), computes the chain exactly once (an RDD checkpoint of an
    uncached Dataset runs it twice: once to count, once to write), and keeps column pruning
    and filter pushdown for every reader. Used where several aggregates read the same
    derived input in one query, and once per round in iterative work. ``compression``: a parquet codec
    in place of the session's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return spark.read.parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Deletes everything that this application has written through ``scratch_path``. For the end of a
    long session, when no DataFrame that reads a written stage is used any more."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tallyframe/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
