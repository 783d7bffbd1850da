"""Language identification: phrases equal brute-force parsing; held-out texts are recognised."""

import random

import numpy as np

from barloom.llm.language import (
    LanguageModel, fit_languages, fold, identify_languages, spelt,
)

LANGS = {
    "en": "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun ",
    "de": "der schnelle braune fuchs springt über den faulen hund und schläft dann im garten ",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et dort après dans le pré ",
}


def brute_phrases(text, corpus):
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at:at + size] in corpus:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_phrases_equal_brute_force():
    model = LanguageModel.fit({k: [v] for k, v in LANGS.items()}, chars=10_000)
    texts = [fold(t) for t in ["The dog sleeps", "Hund und Fuchs über", "zzz qqq", "a", "",
                               "le chien et the dog " * 30]]
    got = model.phrases(texts)
    longest = max(LANGS, key=lambda k: len(fold(LANGS[k])))
    for i, text in enumerate(texts):
        for j, lang in enumerate(model.languages):
            corpus = fold(LANGS[lang])  # the longest keeps back a tenth
            kept = len(corpus) - len(corpus) // 10 if lang == longest else len(corpus)
            assert got[i, j] == brute_phrases(text, corpus[:kept])


def test_rare_characters_are_spelt():
    symbols = {"a": 16, " ": 17}
    assert spelt("a\u4e2d \U0001f600", symbols).tolist() == [
        16, 4, 14, 2, 13, 17, 0, 1, 15, 6, 0, 0]
    texts = {k: [v] for k, v in LANGS.items()}
    model = LanguageModel.fit(texts, 10_000, direct=5)  # most letters are spelt
    for i, lang in enumerate(model.languages):
        text = fold(LANGS[lang][10:60])
        assert model.phrases([text])[0].argmin() == i
        other = model.phrases(["", text, "x", text * 3])
        assert other[1].tolist() == model.phrases([text])[0].tolist()


def _texts(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    return [" ".join(rng.choice(words) for _ in range(200)) for _ in range(n)]


def test_scripts_beyond_latin_are_told_apart(spark):
    rng = random.Random(3)
    han = [chr(0x4e00 + i) for i in range(0, 6000, 2)]
    letters = {"h1": rng.sample(han, 500), "h2": rng.sample(han, 500),
               "c1": [chr(0x430 + i) for i in range(20)], "c2": [chr(0x43a + i) for i in range(20)],
               "l1": "abcdefghij", "l2": "fghijklmno"}
    texts = {k: _texts(rng, v, 16) for k, v in letters.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify_languages(df.where("doc_id % 4 = 2"), fit_languages(df.where("doc_id % 4 <> 2")))
    assert all(r["doc"]["lang"] == r["lang_pred"] for r in found.collect())


def test_a_rare_label_leaves_other_predictions_and_is_found(spark):
    rng = random.Random(4)
    texts = {k: _texts(rng, v, 60) for k, v in (("a", "abcdefghij"), ("b", "efghijklmn"))}
    rare = _texts(rng, "klmnopqrst", 1)[0]
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema)
    learned = df.where("doc_id % 4 <> 2")
    one = spark.createDataFrame([(900, rare[:300], "r")], schema)
    plain, more = fit_languages(learned), fit_languages(learned.union(one))
    assert more.factors[2] < 0.8 < plain.factors.min()
    before, after = ({r["doc"]["doc_id"]: r["lang_pred"] for r in identify_languages(df, m).collect()}
                     for m in (plain, more))
    assert before == after and all(before[i] == k for i, _, k in rows)
    assert identify_languages(spark.createDataFrame([(1, rare[300:], None)], schema),
                              more).first()["lang_pred"] == "r"


def test_tables_give_languages_scores_and_und(spark):
    rows = [(i, LANGS[lang], lang) for i, lang in enumerate(list(LANGS) * 3)] + [
        (90, None, "en"), (91, "123 !?", "en"), (92, "the lazy dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(df)
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, "The Fox And The Dog"), (2, "SCHLÄFT DANN IM GARTEN"), (3, "dans le pré"),
            (4, None), (5, ""), (6, "42"), (6, "42"), (None, "the warm sun " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "doc_id long, text string, lang_pred string")
    got = identify_languages(df, model).collect()
    found = {r["doc"]["doc_id"]: r["lang_pred"] for r in got}
    assert found == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 6: "und", None: "en"}
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert identify_languages(df.limit(0), model).count() == 0


def test_without_labels_everything_is_unknown(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = fit_languages(df)
    assert identify_languages(df, model).first()["lang_pred"] == "und"


def test_held_out_accuracy(spark, sf):
    from barloom.llm.queries import op8_cross_parsing_language
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op8_cross_parsing_language(spark, sf).join(docs, "doc_id").where("held_out").collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert right >= 0.95
