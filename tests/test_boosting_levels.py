"""What a level of a tree costs: sisters are not both counted, and scoring needs no huge expression."""

from functools import partial

import numpy as np
import pytest

from barloom.operators import boosting as B
from barloom.operators import model as G
from barloom.operators.features import FEATURE_NAMES


def test_only_the_smaller_sister_is_counted(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(B, "partial", lambda f, **more: (
        asked.append((more["level"], list(more["asked"]))) if f is B._histograms else None,
        partial(f, **more))[1])
    rows = spark.range(200).selectExpr(
        "cast(id % 10 as smallint) a", "cast(id % 7 as smallint) b", "cast(id % 10 > 2 as double) y")
    tree = B.boost(rows.repartition(3), 1, 1.0, n_bins=10, maxIter=1, stepSize=1.0, maxDepth=2,
                   minInstancesPerNode=1)[0][0]
    assert asked == [(0, [[1]]), (1, [[2]])]  # 60 of 200 rows go left
    assert (tree.feature[1], tree.cut[1]) == (0, 2)
    assert tree.value[2:4].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("n_bins", [10, 100])  # features in pairs and one by one
def test_histograms_equal_plain_sums(n_bins):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, n_bins, (3, 500)).astype(np.uint8)
    left = rng.integers(-9, 9, (1, 500)).astype(float)
    left[0, ::11] = np.nan
    found = B._histograms((bins, left), [], [None], [[1]], 0, 3, True, 1.0, n_bins)
    for i, b in enumerate(bins):
        for k in range(n_bins):
            of = left[0][(b == k) & ~np.isnan(left[0])]
            assert found[0, :, 0, i, k].tolist() == [len(of), of.sum(), 0]


def test_scores_are_no_expression_of_all_trees(spark):
    """360 trees as one expression were too large for generated code."""
    nodes = [n for t in range(120) for n in (
        (t, 1, "ret_1d", 0.0, 0.0), (t, 2, None, None, 1.0), (t, 3, None, None, 2.0))]
    model = G.Trees(tuple(nodes), (1.0,) * 120, (0.0,) * 9)
    rows = spark.range(3).selectExpr(*[
        f"case id when 0 then -1d when 1 then 0d else double('nan') end {n}" for n in FEATURE_NAMES])
    scored = G.score_panel(rows, {1: model, 3: model, 5: model})
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000
    assert sorted(r.score for r in scored.collect()) == [120.0, 120.0, 240.0]
