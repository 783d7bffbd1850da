"""The state of a stream is dealt by the size of its input."""

from barloom import streaming as Z


def test_state_partitions_follow_the_input(spark, tmp_path):
    spark.range(0, 1000, 1, 40).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = spark.read.parquet(f"{tmp_path}/t")
        assert Z.state_partitions(read) == 2 * read.rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    session = Z.streaming_session(spark, 20)
    assert session.conf.get("spark.sql.shuffle.partitions") == "20"
    assert session.conf.get(
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
