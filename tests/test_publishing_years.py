"""Copies of a published dataset that the queries change, written year by year."""

import __spark_entry__ as entry
from parity import compare, duck

# Thresholds under which adaptive execution splits a year of this little data.
TINY = {
    "spark.sql.files.maxPartitionBytes": "40k", "spark.sql.files.openCostInBytes": "4k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "12k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.autoBroadcastJoinThreshold": "1k",
}


def test_a_large_year_stays_one_file(spark, sf):
    before = {k: spark.conf.get(k, None) for k in TINY}
    for k, v in TINY.items():
        spark.conf.set(k, v)
    try:
        ok, note = compare(spark, duck(sf), sf, "pk_order", entry.queries()["pk_order"],
                           entry.oracle_sql()["pk_order"])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert ok, note
