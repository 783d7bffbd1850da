"""Boosted trees against Spark's own, whatever the tasks, and the jobs that they take."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from barloom.operators import model as G
from barloom.operators.features import FEATURE_NAMES
from helpers import d


def matrix_of(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = [round(rng.gauss(0, 1), 3) for _ in FEATURE_NAMES]
        y = x[0] * 2 + (x[2] > 0.3) + rng.random() / 5
        rows.append((f"{i % 9:06d}.SZ", d(f"2026-01-{1 + i // 9 % 28:02d}"), *x, y,
                     None if i % 7 == 0 else y * x[1]))
    names = ", ".join(f"{n} double" for n in FEATURE_NAMES)
    return spark.createDataFrame(
        rows, f"symbol string, trade_date date, {names}, label_1 double, label_3 double")


def test_trees_equal_those_of_spark(spark, monkeypatch):
    matrix = matrix_of(spark)
    settings = dict(maxIter=13, maxDepth=3, stepSize=0.3, minInstancesPerNode=10)
    monkeypatch.setattr(G, "ROWS_PER_TASK", 90)  # several tasks
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosting", "boosting")
    found = G.fit_multi_horizon(matrix, (1, 3), bins=8, **settings)
    n = len(jobs.getJobIdsForGroup("boosting"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n <= 13 * 3 + 10  # three levels a round, whatever the number of labels
    edges = G.bin_edges(matrix, matrix.count(), bins=8)
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features")
    for h in (1, 3):
        binned = assembler.transform(matrix.where(f"label_{h} is not null").select(
            f"label_{h}", *G.binned(matrix, edges)))
        want = G.read_trees(GBTRegressor(labelCol=f"label_{h}", maxBins=8, seed=1, **settings)
                            .fit(binned), edges)
        splits = [{n[:4] for n in t.nodes if n[2]} for t in (found[h], want)]
        assert splits[0] == splits[1] and len(splits[0]) > 20
        assert found[h].weights == want.weights
        assert found[h].importances == pytest.approx(want.importances)
        leaves = [{n[:2]: n[4] for n in t.nodes if not n[2]} for t in (found[h], want)]
        assert leaves[0] == pytest.approx(leaves[1])


def test_tasks_do_not_change_a_tree(spark, monkeypatch):
    matrix = matrix_of(spark)
    fits = []
    for rows_per_task in (30, 1000):
        monkeypatch.setattr(G, "ROWS_PER_TASK", rows_per_task)
        fits.append(G.fit_multi_horizon(matrix, (1, 3), maxIter=4))
    assert fits[0] == fits[1]
    with pytest.raises(ValueError, match="not finite"):
        G.fit_multi_horizon(matrix.withColumn("label_1", F.lit(float("nan"))), (1,), maxIter=1)
