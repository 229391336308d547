"""Words whose probability would vanish: their scores and expected uses."""

from __future__ import annotations

import numpy as np
import pytest

from ravine.llm.language_id import Lattice, Model, predict
from tests.llm.test_language_id import PIECES


def rare(langs=2):
    """Bytes and the piece b are as rare as pieces that training did not see."""
    t = np.random.default_rng(4).uniform(1e-9, 1e-8, (len(PIECES) + 256, langs))
    t[[PIECES.index("▁"), PIECES.index("a")]] = 0.5
    return t


@pytest.mark.parametrize("letters", [10, 13, 14, 20, 40, 48, 49, 60])
def test_runs_of_unknown_letters_have_a_probability(letters):
    t = rare()
    spelt = [np.log(t[len(PIECES) + b]) for b in "語".encode()]
    want = np.log(0.5) + letters * np.sum(spelt, axis=0)
    words = ["▁" + "語" * letters, "▁" + "a" * letters]
    got = Lattice(PIECES, t).scores(words)
    assert np.allclose(got[0], want) and np.isfinite(got).all()
    uses = Lattice(PIECES, t).expected(words, np.array([[2.0, 3.0], [0.0, 0.0]]))
    for b in "語".encode():
        assert np.allclose(uses[len(PIECES) + b], np.array([2.0, 3.0]) * letters * "語".encode().count(b))


def test_very_long_words_are_scored_place_by_place():
    t = rare()
    one = Lattice(PIECES, t)
    for word in ("▁" + "ab" * 900 + "語" * 30, "▁" + "b" * 2000, "▁" + "語é" * 600):
        spans = one.matches([word])
        assert np.allclose(one.log_long(word), one.log_forward(len(word), spans)[len(word)][0])
        assert np.allclose(one.scores([word, "▁a"])[0], one.log_long(word))
    whole = one.scores(["▁" + "ab語" * 70_000])
    assert np.isfinite(whole).all()


def test_scores_stay_between_0_and_1(spark):
    texts = [(n, "aba " + c * n) for c in ("語", "𐐨", "b") for n in range(10, 61)]
    model = Model(("x", "y"), PIECES, rare())
    got = predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
