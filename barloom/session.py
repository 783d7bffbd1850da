"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings the operators are planned for."""
    builder = (
        SparkSession.builder.appName("barloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def wide_session(spark: SparkSession) -> SparkSession:
    """A sibling session whose shuffles begin with 16 partitions a core, which adaptive execution
    merges to 16 MB, so a task holds little of the table whatever the number of partitions the
    caller has set. It has every other setting of the caller, whose own stay as they are. Keys and
    dates pack to a twelfth or less of what they take in a task, which is why the size is small.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               16 * spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(most))
    session.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session in one process (``local`` or ``local[...]``) may fall back to a temporary
    folder: on any cluster such a folder is lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-barloom-")
    return _LOCAL_ROOT[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/barloom/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and fixes anything that depends on task placement, so a lost
    executor cannot change it.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
