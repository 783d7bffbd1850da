"""Fingerprints: equal texts agree, estimates follow the exact similarity, successors are right."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from barloom.llm.fingerprints import Fingerprinter, compare_with_next, fingerprint_documents


def exact(a, b, width=5):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_estimates_are_near_the_exact_similarity():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = [rng.choice(words) for _ in range(600)]
        b = a[:int(600 * share)] + [rng.choice(words) for _ in range(600 - int(600 * share))]
        pairs.append((" ".join(a), " ".join(b)))
    maker = Fingerprinter()
    x = maker.of(pa.array([p[0] for p in pairs]))
    y = maker.of(pa.array([p[1] for p in pairs]))
    for got, (a, b) in zip(maker.likeness(x, y), pairs, strict=True):
        assert abs(got - exact(a, b)) < 0.1


def test_packed_bits_round_trip_and_sparse_rows_are_filled():
    for bits in (1, 2, 4, 8):
        maker = Fingerprinter(bins=64, bits=bits)
        low = maker.of(pa.array(["one", "one two", " ".join(map(str, range(300))), ""]))
        for row, text in zip(low, maker.pack(low), strict=True):
            assert (maker.unpack(text) == row).all()
    assert not low[3].any()
    assert len(set(low[0].tolist())) == 1  # one shingle fills every bin with its value


def test_densification_agrees_in_both_forms():
    maker = Fingerprinter(bins=64)
    rng = np.random.default_rng(1)
    table = np.full((1, 64), np.uint64(0xFFFFFFFFFFFFFFFF))
    have = rng.choice(64, 40, replace=False)
    table[0, have] = np.arange(40, dtype=np.uint64)
    full = table[0] != np.uint64(0xFFFFFFFFFFFFFFFF)
    want = table[0].copy()
    for i in np.flatnonzero(~full):
        turns = maker._turns()[i]
        want[i] = table[0, have[np.argmin(turns[have])]]
    maker._densify(table)
    assert (table[0] == want).all()


def test_successors_edits_nulls_and_repeats(spark):
    rows = [(30, "gamma delta epsilon zeta eta theta"), (10, "alpha " * 9), (20, None), (40, ""),
            (25, "Ünï " * 7), (25, "Ünï " * 7), (None, "last of all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows],
                               "doc_id long, text string, fingerprint string")
    got = sorted(compare_with_next(df).collect(),
                 key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    for i, r in enumerate(got):
        text, after = want[i][1] or "", want[(i + 1) % len(want)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[2]["near_next"] == 1.0
    assert compare_with_next(df.limit(0)).count() == 0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint_documents(df).collect()}
    assert plain[30] == next(r["fingerprint"] for r in got if r["doc_id"] == 30)


def test_many_ranges_keep_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 501, f"text {i * 7 % 501} of many words") for i in
                                range(501)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in compare_with_next(df).collect()}
    assert len(got) == 501
    for i in range(501):
        text, after = f"text {i} of many words", f"text {(i + 1) % 501} of many words"
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
