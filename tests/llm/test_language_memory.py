"""Fitting holds little beside the model, and keys of lines leave room for packing."""

import random
import tracemalloc

import numpy as np

from barloom.llm.language import LanguageModel
from barloom.llm.lines import segment_keys


def test_fit_holds_little_beside_the_model():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüß", k=rng.randint(2, 9)))
             for _ in range(3000)]
    texts = {lang: [" ".join(rng.choices(words, k=size))]
             for lang, size in (("a", 4000), ("b", 4000), ("c", 4000), ("d", 1500))}
    tracemalloc.start()
    model = LanguageModel.fit(texts, 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Reserved, of which about two thirds are used, and the table of one language.
    assert peak < 2.4 * model.steps.nbytes


def test_keys_keep_forty_bits():
    lines = [f"line {i} of some length with words" for i in range(2000)]
    _, key, _ = segment_keys(lines, 2)
    assert not (key & np.uint64(0xFFFFFF)).any()
    assert len(np.unique(key)) > 2000
