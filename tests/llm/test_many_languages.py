"""Operators 2 and 4 where languages and tokens are many."""

import random

import numpy as np
import pytest

from grainline.llm import lang_kernel, suffix_lm


def invented(k):
    """Texts of language k, in an alphabet of its own."""
    r = random.Random(k)
    letters = [chr(0x4E00 + 12 * k + i) for i in range(12)]
    return lambda: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(12))


def test_every_one_of_200_languages_is_recognised():
    say = [invented(k) for k in range(200)]
    rows = np.stack([lang_kernel.grams_present(s()) for s in say for _ in range(20)])
    model = lang_kernel.fit(rows, [f"l{k:03d}" for k in range(200) for _ in range(20)])
    assert model.landmarks.shape[1] == 800
    held = np.stack([lang_kernel.grams_present(s()) for s in say for _ in range(3)]).astype(np.float32)
    right = model.scores(held).argmax(1) == np.repeat(np.arange(200), 3)
    assert right.mean() > 0.98 and right.reshape(200, 3).any(1).all()


def test_landmarks_grow_with_the_languages():
    assert [lang_kernel.landmarks_for(n) for n in (1, 4, 32, 100, 512, 1000, 4000)] == [128, 128, 128, 400, 2048, 2048, 4000]


def test_equal_scores_go_to_the_first_language_and_long_texts_are_whole(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["de", "en"] * 30)] + [(i, "andere wörter", "fr") for i in range(60, 90)]
    rows += [(500, "same words here", None), (501, "same words here " * 30_000, None), (501, "same words here", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, score string, held_out double")
    got = {(r["doc_id"], r["lang_pred"]) for r in lang_kernel.predict(df).where("doc_id >= 500").collect()}
    assert got == {(500, "de"), (501, "de")}


@pytest.mark.parametrize("n", [10**4, 10**8, 10**10, 10**12, 10**13])
def test_hot_words_cover_all_that_the_tree_may_hold(n):
    hot = suffix_lm.enough(n, 5e-7, 1800.0, 2)
    least, least_next = suffix_lm.enough(n, 2e-5, 180.0, 2), suffix_lm.enough(n, 2e-6, 1800.0, 2)
    assert hot <= least_next <= least and n // hot < suffix_lm.MASK
