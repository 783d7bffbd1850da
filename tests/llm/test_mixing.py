"""Mixing: exact targets, taken words near them, no document above its bound."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from barloom.llm.mixing import balanced, mix_sources, rate, source_targets


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check(spark, rows, slack):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["mix_size"] == len((r["text"] or "").split())
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
        assert r["mix_taken"] == r["mix_copies"] * r["mix_size"] and 0 <= r["mix_copies"] <= 3
    want = targets(sizes)
    for r in got:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert abs(r["mix_target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack
    again = mix_sources(df).collect()
    assert sorted((r["doc_id"] or -1, r["mix_copies"]) for r in got) == sorted(
        (r["doc_id"] or -1, r["mix_copies"]) for r in again)


def test_sources_of_many_sizes(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 5}" if i % 11 else None, 1)
            for i in range(600)]
    check(spark, rows, slack=3)


def test_one_hot_source_with_equal_documents(spark):
    rows = [(i, "a b c", "hot", 1) for i in range(500)] + [
        (1000 + i, "w " * (i + 1), "small", 1) for i in range(20)]
    check(spark, rows, slack=20)


def test_nulls_empty_texts_repeats_and_empty_table(spark):
    rows = [(1, None, "a", 1), (2, "", None, 2), (2, "", None, 2), (None, "x y", "a", 3)]
    check(spark, rows, slack=6)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    assert mix_sources(df.limit(0)).count() == 0
    assert mix_sources(df.where("text = ''")).count() == 2


def test_rates_solve_the_entropy_problem(spark):
    """Against a plain bisection of each source's multiplier: rates exp(tilt * size), 3 at most."""
    rows = [(f"s{i % 3}", 1 + i * 53 % 70, 1 + i % 4) for i in range(90)]
    cells = spark.createDataFrame(rows, "s string, size long, n long").groupBy("s", "size").agg(
        F.sum("n").alias("n"))
    state = balanced(cells, source_targets(cells, (1.0, 2.0, 3.0), 3), 3, 1e-12, 60)
    found = cells.join(state, "s").select("s", "size", "n", "target", rate(3).alias("rate")).collect()
    for source in {r["s"] for r in found}:
        own = [r for r in found if r["s"] == source]

        def tokens(tilt, own=own):
            return sum(r["n"] * r["size"] * math.exp(min(math.log(3), tilt * r["size"])) for r in own)

        low, high = -5.0, 5.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if tokens(middle) < own[0]["target"] else (low, middle)
        for r in own:
            assert abs(r["rate"] - math.exp(min(math.log(3), low * r["size"]))) < 1e-6
