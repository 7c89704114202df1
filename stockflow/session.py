"""Session settings and the shared folders jobs may write intermediate data to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "stockflow", master: str | None = None, shuffle_partitions: int | None = None):
    """A session with the settings the operators are written for (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a folder of its own: on a cluster a
    machine-local path would be lost together with the executor that wrote it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stockflow-"))
    return sc.getCheckpointDir()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable on this session."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


_SCRATCH: list[str] = []  # folders this driver has named, until they are cleared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for intermediate files next to the checkpoints."""
    _SCRATCH.append(f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def delete(spark: SparkSession, *paths: str) -> int:
    """Delete folders of intermediate files, where they exist; how many there were."""
    gone = 0
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate files of this run; results that still read them must have been written by then."""
    gone = delete(spark, *_SCRATCH)
    _SCRATCH.clear()
    return gone


def narrow(df: DataFrame) -> bool:
    """Whether ``df`` would run in fewer tasks than the session has cores, by its plan; no list of files is made."""
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def store(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and its size is known to the planner.

    Used for small fitted tables, which the planner then broadcasts if, and only if, they turned out small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder, for work that reads it many times.

    Later passes scan only the columns they need, do not repeat the joins behind ``df``, and survive the
    loss of executors.  The rows are rebalanced on the way, so that files are neither tiny nor huge.
    """
    return store(df.hint("rebalance"), label)


def widen(df: DataFrame) -> DataFrame:
    """A plain scan for work that reads it several times: as it is, or spread over the cores if it is less than a task for each."""
    return store(df.repartition(df.sparkSession.sparkContext.defaultParallelism), "wide") if narrow(df) else df
