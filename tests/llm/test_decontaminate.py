"""Decontamination equals a plain search of every window in every text."""

import random
import re

import pytest

from barloom.llm.decontaminate import decontaminate, scan_windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, doc string, n_hit int, spans string, item_ids int, `left` int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, items, width):
    found = list(WORD.finditer(low(text)))
    w, hit, ids = [m[0] for m in found], set(), set()
    for item, body in items:
        v = WORD.findall(low(body))
        n = min(len(v), width)
        for window in {tuple(v[p:p + n]) for p in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == window:
                    hit.update(range(i, i + n))
                    if item is not None:
                        ids.add(str(item))
    spans, last = [], None
    for i in sorted(hit):
        if last == i - 1:
            spans[-1][1] = found[i].end()
        else:
            spans.append([found[i].start(), found[i].end()])
        last = i
    return len(w), len(hit), [tuple(s) for s in spans], sorted(ids)


def cases(seed, width):
    rng = random.Random(seed)
    words = ["the", "Café", "的", "B2", "no", "x" * 30, *[f"w{i}" for i in range(9)]]

    def body(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))

    items = [(i, body(rng.randint(1, 3 * width))) for i in range(12)]
    items += [(3, "another one of id three and more"), (None, body(width)), (90, None), (91, "..."),
              (92, items[0][1]), (92, items[0][1])]
    docs = []
    for i in range(60):
        parts = [body(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            v = WORD.findall(rng.choice(items)[1] or "")
            at = rng.randint(0, len(v))
            parts += [" ".join(v[at:at + rng.randint(0, 2 * width)]).upper(), body(rng.randint(0, 9))]
        docs.append((i, "; ".join(parts)))
    docs += [(100, None), (101, ""), (102, " \n"), (7, docs[7][1]), (None, docs[3][1]),
             (103, docs[0][1] * 900)]
    return docs, items


@pytest.mark.parametrize(("width", "most"), [(4, 100_000), (4, 7), (10, 40)])
def test_equals_plain_search_in_one_block_and_in_many(spark, width, most):
    docs, items = cases(width, width)
    df = spark.createDataFrame([(*d, "d", 1, "s", 2, 3) for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, value string")
    rows = scan_windows(df, bench, width=width, most=most).collect()
    got = sorted((str(r["doc"]["doc_id"]), r["n_words"], r["n_hit"],
                  [tuple(s) for s in r["spans"]], r["item_ids"]) for r in rows)
    assert got == sorted((str(i), *plain(t, items, width)) for i, t in docs)
    assert all(r["doc"]["left"] == 3 and r["doc"]["doc"] == "d" for r in rows)


def test_removal(spark):
    df = spark.createDataFrame(
        [(1, "Keep this, the quick brown fox jumps! And this.", "d", 1, "s", 2, 3),
         (2, "clean text", "d", 1, "s", 2, 3), (3, None, "d", 1, "s", 2, 3),
         (4, "The QUICK brown fox", "d", 1, "s", 2, 3)], SCHEMA)
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate(df, bench).collect()}
    assert cut == {1: "Keep this,   jumps! And this.", 2: "clean text", 3: None}
    whole = decontaminate(df, bench, drop="documents")
    assert whole.columns == df.columns
    assert {r["doc_id"] for r in whole.collect()} == {2, 3}
    assert {r["doc_id"] for r in decontaminate(df, bench.limit(0)).collect()} == {1, 2, 3, 4}
    assert decontaminate(df.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="drop"):
        decontaminate(df, bench, drop="lines")
