"""Importance resampling equals a plain version that reads every text whole."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from barloom.llm.importance import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank int, k1 string, hot string, first int, line string"


def runs(text, order):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, order=1, size=10_000, percent=10, least=20):
    def counts(texts):
        c = Counter()
        for t in texts:
            c.update(zlib.crc32(f.encode()) % size for f in runs(t, order)[1])
        return c, sum(c.values())

    (s, all_s), (t, all_t) = counts(x for _, x in docs), counts(target)
    rows = []
    for i, text in docs:
        w, f = runs(text, order)
        weight = sum(math.floor(1000 * math.log(
            (t[b] + 1) * (all_s + size) / ((s[b] + 1) * (all_t + size))))
            for b in (zlib.crc32(x.encode()) % size for x in f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(f), len(w), weight, score, None])
    fit = sorted((r for r in rows if r[2] >= least),
                 key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[5] = k + 1
    return rows


def text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n", "-"]) for _ in range(n))


@pytest.mark.parametrize("order", [1, 3])
def test_equals_plain_version(spark, order):
    rng = random.Random(order)
    words = ["Straße", "a", "B2", "naïve", "don't", "x" * 70, "的話", *[f"w{i}" for i in range(40)]]
    stock = [text(rng, words, 9) for _ in range(6)]
    docs = [(i, "\n".join([text(rng, words, rng.randint(0, 40)), rng.choice(stock), "ALL  rights"]))
            for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "... !"), (None, text(rng, words, 30)),
             (7, docs[7][1]), (7, docs[8][1]), (504, "word " * 20_000), (505, "z" * 300_000)]
    target = [text(rng, words[:12], 30) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "k", "h", 2, "l") for d in docs], SCHEMA)
    goal = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, n int")
    got = resample(df, goal, order=order, size=257, percent=25).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[5] or 0)
    want = plain(docs, target, order, 257, 25)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert resample(none, docs).count() == 0
    got = {r["doc_id"]: r for r in resample(docs, none, least_words=1, percent=100).collect()}
    want = {r[0]: r for r in plain([(1, "a b"), (2, None)], [], percent=100, least=1)}
    assert {i: list(r) for i, r in got.items()} == want


def test_ties_and_repeated_rows_are_ranked_each(spark):
    docs = [(3, "one two")] * 5 + [(4, "one two")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = resample(df, df, least_words=2, percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 9))
    assert len({(r["doc_id"], r["weight"], r["score"]) for r in got}) == 2
