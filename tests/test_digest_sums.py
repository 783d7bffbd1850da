"""Digests are summed as whole numbers, and equal those that exact integers give."""

import hashlib

from barloom.sources import dataset_fingerprint

IDENTITY = {"family": "bars"}


def test_digest_is_that_of_exact_sums_and_no_row_is_summed_as_a_decimal(spark, capsys):
    rows = [(f"s{i % 700}", i) for i in range(5000)] + [("s1", 1)] * 3
    df = spark.createDataFrame(rows, "a string, b long").repartition(7)
    out = dataset_fingerprint(df, ["a", df.b.cast("string")], IDENTITY)
    sums = [0] * 4
    for a, b in rows:
        digits = hashlib.sha256(f"{a}|{b}".encode()).hexdigest()
        for i in range(4):
            sums[i] += int(digits[15 * i:15 * i + 15], 16)
    text = "|".join(["family=bars", str(len(rows)), *[str(s % 2 ** 60) for s in sums]])
    assert out.first() == (len(rows), hashlib.sha256(text.encode()).hexdigest())
    out.explain()
    plan = capsys.readouterr().out
    assert "partial_sum" in plan and "decimal(20,0)" not in plan
