"""Near-duplicates: components equal those of brute force."""

import random
import re

import numpy as np
import pytest

from barloom.llm.graph import components
from barloom.llm.sketch import near_duplicates, possible_pairs, sets_of, sketches


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
                   or ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, families=12, copies=14, words=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    rows, at = [], 0
    for f in range(families):
        base = shared + [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((at, (" " if f % 2 else "\n").join(w)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "One"), (903, "oNE"), (904, "two words")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in near_duplicates(df, width=4).collect()}
    want = brute(rows, 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_repeats_null_ids_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(5, long), (5, long), (3, long + " tail"), (None, long), (8, " \t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"])
                 for r in near_duplicates(df).collect())
    assert got == [(False, 3, 3, True), (False, 5, 3, False), (False, 5, 3, False),
                   (False, 8, 8, True), (True, None, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    one = a[:1]
    both = np.concatenate([a, b, one])
    begins = np.cumsum([0, len(a), len(b), 1])
    got = sketches(both, begins, 400)
    assert (got != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    alike = (got[0] == got[1]).mean()
    assert abs(alike - 240 / 360) < 0.1


def test_sets_of_short_rows():
    data = np.frombuffer(b"a b c d a b c d e", np.uint8)
    values, begins = sets_of(data, np.array([0, 3, 3, len(data)]), 3)
    assert np.diff(begins).tolist() == [1, 0, len(values) - 1]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_a_family_around_the_threshold_equals_brute_force(spark):
    """Copies of one text with edits of their own: most pairs lie close to the threshold."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in range(rng.choice([1, 2, 2, 3, 3])):
            w[rng.randrange(len(w))] = f"own{i}-{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in near_duplicates(df, width=4).collect()}
    assert got == brute(rows, 4)


@pytest.mark.parametrize("block_rows", [2048, 30])
def test_possible_pairs_equal_all_pairs(spark, block_rows):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), i, rng.randint(90, 120), rng.randint(0, 3),
             [rng.randint(0, 2) for _ in range(64)]) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, rep long, n int, c long, shared array<int>")
    got = possible_pairs(df, 21, block_rows).collect()
    want = set()
    for x in rows:
        for y in rows:
            common = sum(map(min, x[4], y[4]))
            if (x[0] == y[0] and x[1] < y[1] and x[3] != y[3]
                    and 100 * min(x[2], y[2]) >= 21 * max(x[2], y[2])
                    and 100 * common >= 21 * (x[2] + y[2] - common)):
                want.add((x[1], y[1]))
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want) and want
