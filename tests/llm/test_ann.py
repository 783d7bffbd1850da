"""Nearest neighbours: recall against brute force, exact scores, ties and odd rows."""

import numpy as np

from barloom.llm.ann import scan, search

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(ids, x, query, k):
    score = x @ x[query]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(score[i])) for i in order[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + 0.6 * rng.standard_normal((1500, 24))).astype("f4")
    x *= rng.uniform(0.5, 1.5, (1500, 1)).astype("f4")
    df = spark.createDataFrame([(i, x[i].tolist(), "r") for i in range(1500)], SCHEMA)
    rows = search(df, df.where("vec_id % 20 = 0"), k=10).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wide, ids, hits = x.astype("f8"), np.arange(1500), 0
    for q in range(0, 1500, 20):
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        for _, v, s in mine:
            assert abs(s - wide[q] @ wide[v]) < 1e-9
        hits += len({m[1] for m in mine} & {v for v, _ in brute(ids, wide, q, 10)})
    assert hits >= 0.9 * 750


def test_equal_vectors_odd_rows_and_few_candidates(spark):
    one, two = [1.0, 0.0, 2.0], [0.5, 1.0, -1.0]
    rows = [(i, one, "a") for i in range(60)] + [
        (100, two, "b"), (100, two, "b"), (101, None, ""), (102, [0.0, 0.0, 0.0], ""),
        (103, [float("nan"), 1.0, 1.0], ""), (104, [None, 1.0, 1.0], ""), (105, [1.0], ""),
        (106, [float("inf"), 1.0, 1.0], ""), (107, [], ""), (None, one, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    assert sorted(got[0]) == [(i + 1, i + 1, 5.0) for i in range(5)]
    assert sorted(got[40]) == [(i + 1, i, 5.0) for i in range(5)]
    assert sorted(got[100]) == [(i + 1, i, -1.5) for i in range(5)]
    few = df.where("vec_id in (0, 100)")
    assert {(r["query_id"], r["vec_id"]) for r in search(few, few).collect()} == {
        (0, 100), (100, 0)}
    assert search(df.limit(0), df).count() == 0
    assert search(df, df.limit(0)).count() == 0


def test_scan_keeps_all_pairs_within_the_limit_in_all_columns():
    rng = np.random.default_rng(2)
    q, x = rng.standard_normal((5, 40)).astype("f4"), rng.standard_normal((300, 40)).astype("f4")
    far = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    limit = np.quantile(far, 0.1, axis=1)
    kept = set(zip(*scan(q, x, limit), strict=True))
    near = {(i, j) for i in range(5) for j in range(300) if far[i, j] <= limit[i]}
    assert len(kept & near) >= 0.95 * len(near)
    assert len(kept) <= len(near) + 2
