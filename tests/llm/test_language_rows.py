"""The rows of the language model are as wide as their own language, and parse as before."""

import random

from barloom.llm.language import AT_ONCE, LanguageModel, fold, identify_languages


def phrases_by_search(text, known):
    """Phrases of ``text`` by looking each one up in ``known``; a character it lacks ends one."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end + 1] in known:
            end += 1
        count, at = count + 1, end
    return count


def words_of(rng, letters, size):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(size))


def test_a_row_is_as_wide_as_its_language():
    rng = random.Random(3)
    alphabets = {"a": "abcdefghijkl", "b": "mnopqrstuvwx", "c": "âêîôûäëïöüÿç"}
    texts = {lang: [words_of(rng, letters, 800)] for lang, letters in alphabets.items()}
    model = LanguageModel.fit(texts, 100_000)
    # At most twice as many states as characters; twelve letters, the space and all others.
    most = sum(2 * len(fold(t[0])) + 2 for t in texts.values()) * 14 * 4
    assert model.steps.nbytes <= most
    mixed = [fold(words_of(rng, "".join(alphabets.values()), n)) for n in (1, 3, 40, 900)]
    own = [fold(words_of(rng, alphabets[k], 30)) for k in alphabets] * 10
    found = model.phrases(mixed + own + [""])
    read = {lang: fold(t[0]) for lang, t in texts.items()}
    longest = max(read, key=lambda k: len(read[k]))  # keeps a tenth back
    read[longest] = read[longest][:len(read[longest]) - len(read[longest]) // 10]
    for text, row in zip(mixed + own, found.tolist(), strict=False):
        assert row == [phrases_by_search(text, read[k]) for k in model.languages]
    assert found[-1].tolist() == [0, 0, 0]


def test_batches_of_many_rows_keep_texts_and_rows_together(spark):
    model = LanguageModel.fit({"en": ["the cat sat on the mat and the dog ran"],
                               "de": ["der hund lief und die katze lag auf der matte"]}, 1000)
    rows = [(i, ("the dog sat", "die katze lief", None, "7")[i % 4]) for i in range(2 * AT_ONCE + 50)]
    df = spark.createDataFrame(rows, "doc_id long, Text string").coalesce(1)
    got = {r["doc"]["doc_id"]: r["lang_pred"] for r in identify_languages(df, model).collect()}
    assert got == {i: ("en", "de", "und", "und")[i % 4] for i, _ in rows}
