"""Toxicity: disguised words are restored, and held-out labels are found."""

import itertools
import random

import numpy as np
import pyarrow as pa

from barloom.llm.toxicity import (
    Restorer, ToxicityModel, fit_toxicity, language_model, score_toxicity, suspects,
    trigram_counts,
)
from barloom.llm.words import utf8

TEXT = "you are such an idiot and a moron what a stupid scum of a loser " * 20


def restorer(spark, text=TEXT):
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    return Restorer(language_model(trigram_counts(df)))


def test_disguises_are_restored(spark):
    model = restorer(spark)
    for written, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"),
                           ("stuuuuupid", "stupid"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"),
                           ("l-o-s-e-r", "loser"), ("STUP1D", "stupid")):
        assert meant in model.restore(f"x {written} y"), (written, model.restore(written))
    assert model.restore("plain words stay") == "plain words stay"
    assert len(model.restore("a" * 50_000 + " b")) > 0


def every_reading(model, word):
    """The best of all readings of a lattice, one by one."""
    best = None
    for path in itertools.product(*model.lattice(word)):
        text, score, p, q = "".join(o for o, _ in path), sum(c for _, c in path), 0, 0
        for c in text:
            k = ord(c) - 96 if "a" <= c <= "z" else 0
            score, p, q = score + model.model[p, q, k], q, k
        score += model.model[p, q, 0]
        if best is None or (round(score, 9), text) > best:
            best = (round(score, 9), text)
    return best[1]


def test_decoding_equals_all_readings(spark):
    model, rng = restorer(spark), random.Random(1)
    for _ in range(150):
        word = "".join(rng.choice("idot1035$!.- aab") for _ in range(rng.randint(1, 9)))
        assert model.decode(word) == every_reading(model, word), word


def test_long_disguises_are_read_as_one(spark):
    model = restorer(spark)
    word = "1d10t.m0r0n." * 20  # ends of 64 characters fall inside words
    assert model.decode(word) == "idiotmoron" * 20
    assert model.known.get(word) is None


def test_every_form_of_disguise_is_marked_and_restored(spark):
    model = restorer(spark, TEXT + "such shit such an ass " * 20)
    for written, meant in (
            ("i  d  i  o  t", "idiot"), ("i. d. i. o. t", "idiot"), ("i_d_i_o_t", "idiot"),
            ("_i_d_i_o_t_", "idiot"), ("i__d__i__o__t", "idiot"), ("idio7", "idiot"),
            ("idio7!", "idiot"), ("lo$3r", "loser"), ("sc*m", "scum"),
            ("stup!d", "stupid"), ("a$$", "ass"), ("shi7", "shit"),
            ("i d 1 o t", "idiot"), ("1.d.1.0.t", "idiot"), ("1 d 1 0 7", "idiot"),
            ("schüüün", "schün"), ("SCHÜüÜN", "schün"), ("d.ü.n.n", "dünn"),
            ("ё.л.к.а", "ёлка"), ("жжжук", "жук")):
        for text in (written, f"ja {written} ja", f"({written})", f"ü {written}"):
            assert suspects(*utf8(pa.array([text])))[0], text
            assert meant in model.restore(text), (text, model.restore(text))
    for text in ("plain words stay", "1 2 3 4 5", "the years 1999 and 2001", "dünn und schön",
                 "a_b snake_case_name", "x - y - z"):
        assert model.restore(text) == text
    assert model.restore("what a loser!") in ("what a loser", "what a loser!")


def test_suspects_agree_with_the_restorer_on_random_texts(spark):
    import random
    rng, model = random.Random(5), restorer(spark)
    texts = ["".join(rng.choice("aabü ЖжÜς Σ1$!.-_ _xİ%\n") for _ in range(rng.randint(0, 12)))
             for _ in range(4000)]
    marked = suspects(*utf8(pa.array(texts)))
    for text, mark in zip(texts, marked, strict=True):
        assert mark or model.restore(text) == text.lower(), text


def test_suspects_mark_every_text_that_restoring_changes(spark):
    model = restorer(spark)
    texts = ["plain", "1d10t", "sooo", "a b c d", "a.b.c.d", "x 12 y", "Ü1a", "", None, "the%%% a"]
    marked = suspects(*utf8(pa.array(texts)))
    for text, mark in zip(texts, marked, strict=True):
        if text and model.restore(text) != text.lower():
            assert mark


def test_fit_and_score_tables(spark):
    docs = [(i, ("good day to all of you " * 3) + ("idiot scum " if i % 3 == 0 else "friends "))
            for i in range(90)] + [(900, None), (901, ""), (902, "1d10t sc0m sc*m"), (902, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(5, 0), (7, None)],
                                   "doc_id long, toxic int")
    model = fit_toxicity(df, labels)
    got = {(r["doc"]["doc_id"], r["doc"]["text"]): r["score"]
           for r in score_toxicity(df, model).collect()}
    assert all((got[i, t] >= 0.3) == (i % 3 == 0) for i, t in docs[:90])
    assert 0 <= got[900, None] == got[901, ""] <= 1
    assert score_toxicity(df.limit(0), model).count() == 0


def test_one_class_or_no_labels():
    for labels in ([], [0, 0], [1]):
        model = ToxicityModel.fit(Restorer(np.zeros((27, 27, 27))), ["a"] * len(labels),
                                  np.array(labels, np.int64))
        assert 0 <= model.score(pa.array(["any text"]))[0] <= 1


def test_held_out_labels(spark):
    from barloom.llm.queries import op7_deobfuscated_toxicity
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op7_deobfuscated_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    found = sum(r["toxic"] and r["predicted"] for r in rows)
    assert found >= 0.5 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.1 * len(rows)
