"""Hard negatives equal a plain search, in one cell and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm.negatives import mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, rid int"


def plain(rows, every=10, k=5, low=80):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows
            if i is not None and lab is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, lj == lab)
                        for b, (j, lj, w) in enumerate(kept) if b != a and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:k]:
            near = [(-n, m) for n, m, same in scored
                    if not same and low * -s <= 100 * -n <= 100 * -s][:k]
            out += [(i, j, r + 1, m, -s, n) for r, (n, m) in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [16_384, 37])
def test_equals_plain_search(spark, block_rows):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((250, 6)) + 0.8).astype("f4")
    x[60:140] = x[60]  # one vector that a third of all rows share
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 3))) for i in range(250)]
    rows += [rows[20], rows[21], (None, rows[0][1], 1), (300, None, 1), (310, rows[1][1], None),
             (320, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (330, [1.0, 2.0], 1), (331, [1.0, 2.5], 1),
             (332, [1.0, 2.2], 2), (340, [math.nan] * 6, 0), (350, [math.inf] * 6, 0), (360, [], 0)]
    got = mine_negatives(table(spark, rows), anchor=F.col("id") % 10 == 0, block_rows=block_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2.9e6, 3.0], 2), (3, [1.0, 1.0], 2)]
    df = table(spark, rows)
    assert sorted(map(tuple, mine_negatives(df).collect())) == plain(rows, every=100)
    huge = table(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e30], 2)])
    assert [tuple(r) for r in mine_negatives(huge).collect()] == [
        (0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]
    assert mine_negatives(df.limit(0)).count() == 0
    assert mine_negatives(df.where("vec_id > 0")).count() == 0
    assert mine_negatives(df.where("label = 1")).count() == 0
    with pytest.raises(ValueError, match="high"):
        mine_negatives(df, high=120)
