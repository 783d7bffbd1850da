"""Line dedup: dropped lines equal those of brute force."""

import random

import pytest

from barloom.llm.lines import (
    deduplicate_lines, dealt, meetings, repeated_lines, segment_keys, within,
)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, edits, least):
    first, out = {}, set()
    for i, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0], r[1])):
        for at, line in enumerate(text.split("\n")):
            if len(line) < least:
                continue
            if line in first:
                out.add((i, at, "exact"))
                continue
            if any(distance(line, old) <= edits for old in first):
                out.add((i, at, "near"))
            first[line] = (i, at)
    return out


def edited(rng, line):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1:], line[:at] + "é" + line[at:],
                           line[:at] + rng.choice("xyz") + line[at + 1:]])
    return line


@pytest.mark.parametrize("seed, edits", [(1, 1), (2, 2), (3, 3)])
def test_dropped_lines_equal_brute_force(spark, seed, edits):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 40)))
             for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases)) if rng.random() < 0.8 else "short"
                          for _ in range(rng.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["at"], r["kind"])
           for r in repeated_lines(df, edits=edits, least=18).collect()}
    assert got == brute(rows, edits, 18)


def test_texts_are_rebuilt(spark):
    a, b = "a line that is long enough to count", "another line, long enough to count"
    rows = [(1, f"{a}\nkeep\n{b}", "s"), (2, f"{a}\n{b}", "s"), (3, f"own line of document three\n{a}",
            "s"), (4, None, "s"), (5, "", "s"), (6, a + "!", "s"), (None, b, "s"),
            (7, "own seven, long enough as well", "x"), (7, "own seven, long enough as well", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in deduplicate_lines(df).collect()
                 if r["text"] is not None)
    assert got == sorted([
        (0, b), (1, f"{a}\nkeep"), (3, "own line of document three"), (5, ""),
        (7, "own seven, long enough as well"), (7, "own seven, long enough as well")])
    assert deduplicate_lines(df).where("text is null").count() == 1
    assert deduplicate_lines(df.limit(0)).count() == 0
    for name in ("exact", "near", "rid", "rc", "_c", "_kept", "lines", "doc", "gone"):
        named = deduplicate_lines(df.withColumnRenamed("at", name))
        assert named.columns == ["doc_id", "text", name]
        assert {r[2] for r in named.collect()} == {"s", "x"}
    assert deduplicate_lines(df).columns == df.columns


def test_very_long_line(spark):
    line = "".join(chr(97 + i * i % 26) for i in range(120_000))
    rows = [(1, line), (2, line[:60_000] + "#" + line[60_000:]), (3, line[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["id"], r["kind"]) for r in repeated_lines(df).collect()] == [(2, "near")]


def test_within_equals_the_distance():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "xy")
        for edits in range(4):
            assert within(a, b, edits) == (distance(a, b) <= edits)


def test_close_lines_share_a_key():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(8, 30)))
        b = edited(rng, a)
        if distance(a, b) > 3:
            continue
        who, key, own = segment_keys([a, b], 3)
        sides = [{(int(k), bool(o)) for w, k, o in zip(who, key, own, strict=True) if w == i}
                 for i in (0, 1)]
        assert any((k, True) in sides[1 - i] for i in (0, 1) for k, _ in sides[i])


def test_a_hot_key_is_dealt_row_by_row(spark):
    from pyspark.sql import functions as F
    n, size = 3000, 20
    probes = spark.range(n).selectExpr("7L as key", "id as h", "id % 3 = 0 as own").unionByName(
        spark.createDataFrame([(8, 1, True), (9, 1, True), (9, 1, False), (10, 1, False),
                               (10, 2, False), (11, 1, True), (11, 2, False)],
                              "key long, h long, own boolean"))
    met = meetings(probes.selectExpr("key", "2 * h + int(own) as h"), size)
    rows = dealt(met)
    for plan in (met, rows):  # no Python step sees a whole key
        assert "InArrow" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["key"] for r in met.select("key").distinct().collect()} == {7, 11}
    blocks = rows.where("key = 7").groupBy("x", "y").agg(F.count("*").alias("n"))
    assert blocks.agg(F.max("n")).first()[0] <= 3 * 2 * 4 * size
    one, two = (rows.where("key = 7").select("x", "y", F.col("h").alias(c),
                                             F.col("part").alias(f"p{c}")) for c in "ab")
    pairs = one.join(two, ["x", "y"]).where("a < b and (x = y or pa <> pb)")
    assert pairs.count() == pairs.distinct().count() == n * (n - 1) // 2


def test_lines_that_all_meet_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "the same first third of it " + "".join(rng.choice("ab") for _ in range(9)) + tail)
            for i, tail in enumerate(["", " one", " and another end"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["at"], r["kind"]) for r in repeated_lines(df, part_rows=7).collect()}
    assert got == brute(rows, 2, 24)
