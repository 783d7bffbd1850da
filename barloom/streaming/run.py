"""Running streams to the end of what is available, into shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_partitions(table: DataFrame) -> int:
    """Two for each part that Spark reads of a stored table, one for each core at least, so that
    the state in one task does not grow with the table."""
    return max(table.sparkSession.sparkContext.defaultParallelism, 2 * table.rdd.getNumPartitions())


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session with settings for stateful streams; the caller's stay as they are.

    The number of state partitions is fixed for the life of a checkpoint, so it is set
    here and not left to adaptive execution. State lives in RocksDB, off the heap, and its rows
    are not counted, which would read each key before it is written.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions",
                     str(partitions or spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return session


def stream_table(spark: SparkSession, folder: str, name_glob: str,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet files of a folder whose names match, with their own schema."""
    schema = spark.read.option("pathGlobFilter", name_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, label: str, mode: str = "append",
                  each_batch: Callable[[DataFrame, int], None] | None = None,
                  checkpoint: str | None = None, output: str | None = None) -> str:
    """Process all available input and return the folder of the results.

    Results go to a Parquet sink in the shared folder, or to ``each_batch``. The
    checkpoint sits beside them, so a lost driver resumes where it stopped.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or fresh_path(spark, f"{label}-state")
    output = output or fresh_path(spark, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True)
    if each_batch is None:
        query = writer.format("parquet").start(output)
    else:
        query = writer.foreachBatch(each_batch).start()
    query.awaitTermination()
    return output
