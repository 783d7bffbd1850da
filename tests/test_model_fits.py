"""Models are fitted with the default settings, for evaluation and for production."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import model as G
from barloom.operators.features import FEATURE_NAMES
from barloom.workload import model_queries as M
from helpers import d
from parity import duck, rows_of


def test_queries_fit_with_the_defaults(spark, sf, monkeypatch):
    class Called(Exception):
        pass

    def fit(matrix, *horizons, **settings):
        assert settings == {} and horizons == ()
        raise Called

    assert G.MODEL_SETTINGS["maxIter"] == 120
    monkeypatch.setattr(G, "fit_multi_horizon", fit)
    for query in (M.fit_multi_horizon, M.score_panel, M.model_fits):
        with pytest.raises(Called):
            query(spark, sf)


def test_usable_rows_and_cutoffs_equal_the_sql(spark, sf, monkeypatch):
    monkeypatch.setitem(G.MODEL_SETTINGS, "maxIter", 1)  # of the trees, only the number is compared
    df = M.model_fits(spark, sf)
    result = duck(sf).execute(entry.oracle_sql()["model_fits"].replace("120 as trees", "1 as trees"))
    names = [d[0] for d in result.description]
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(names, result.fetchall())
    assert len(got) == 6 and len({r[0] for r in got}) == 2


def test_compiled_trees_equal_the_fitted_model(spark):
    """The expression gives what the model predicts on the bins, from the features themselves."""
    rng = random.Random(3)
    rows = [(f"{i % 9:06d}.SZ", d(f"2026-01-{1 + i // 9 % 28:02d}"),
             *[round(rng.gauss(0, 1), 3) for _ in FEATURE_NAMES]) for i in range(250)]
    rows = [(*r, r[2] * 2 + (r[4] > 0.3) + rng.random() / 5) for r in rows]
    names = ", ".join(f"{n} double" for n in FEATURE_NAMES)
    matrix = spark.createDataFrame(rows, f"symbol string, trade_date date, {names}, label_1 double")
    edges = G.bin_edges(matrix, matrix.count(), bins=8, sample=10_000)
    assert all(e == sorted(set(e)) and 1 <= len(e) <= 7 for e in edges)
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features")
    binned = assembler.transform(matrix.select("label_1", *G.binned(matrix, edges)))
    model = GBTRegressor(labelCol="label_1", maxIter=6, maxDepth=3, stepSize=0.3, maxBins=8,
                         seed=1).fit(binned)
    trees = G.read_trees(model, edges)
    assert len(trees.weights) == 6 and abs(sum(trees.importances) - 1) < 1e-9
    got = sorted(round(r[0], 9) for r in G.score_panel(matrix, {1: trees}).select("score").collect())
    want = sorted(round(r[0], 9) for r in model.transform(binned).select("prediction").collect())
    assert got == want and len(set(got)) > 5
    odd = matrix.limit(1).withColumn(FEATURE_NAMES[0], F.lit(None).cast("double"))
    assert G.score_panel(odd, {1: trees}).first().score is None


def test_a_split_is_one_row(spark):
    days = ("train_end", "validation_start", "validation_end", "test_start")
    split = spark.createDataFrame([tuple(d("2026-01-05") for _ in days)] * 2,
                                  ", ".join(f"{n} date" for n in days))
    assert G.small_row(split.limit(1)).count() == 1
    with pytest.raises(Exception, match="a split is one row"):
        G.small_row(split).collect()
