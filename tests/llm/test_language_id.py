"""Language identification: the forward sum against all segmentations, and held-out accuracy."""

from __future__ import annotations

import math
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravine.llm import entries, language_id
from ravine.llm.language_id import Lattice

PIECES = ("a", "b", "ab", "ba", "aba", "▁", "▁a", "abab")


def table(langs=2):
    rng = np.random.default_rng(3)
    t = rng.random((len(PIECES) + 256, langs))
    return t / t.sum(axis=0)


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            yield from ([word[:n], *rest] for rest in segmentations(word[n:]))


@pytest.mark.parametrize("word", ["▁a", "▁ab", "▁abab", "▁babab", "▁abababababbaabab"])
def test_forward_is_the_sum_over_segmentations(word):
    t = table()
    want = sum(np.prod([t[PIECES.index(p)] for p in s], axis=0) for s in segmentations(word))
    assert np.allclose(Lattice(PIECES, t).scores([word])[0], np.log(want))


def test_long_words_do_not_vanish():
    one = Lattice(PIECES, table()).scores(["▁" + "ab" * 400])[0]
    assert np.isfinite(one).all()
    two = Lattice(PIECES, table()).scores(["▁" + "ab" * 800])[0]
    assert (two < one).all() and np.isfinite(two).all()


def test_unknown_characters_are_spelt_by_bytes():
    t = table()
    want = np.log(t[PIECES.index("▁")] * np.prod([t[len(PIECES) + b] for b in "é".encode()], axis=0))
    assert np.allclose(Lattice(PIECES, t).scores(["▁é"])[0], want)


def test_expected_uses_are_posterior_counts():
    t, word = table(), "▁abab"
    got = Lattice(PIECES, t).expected([word], np.ones((1, 2)))
    weights = [(s, np.prod([t[PIECES.index(p)] for p in s], axis=0)) for s in segmentations(word)]
    total = sum(w for _, w in weights)
    want = np.zeros_like(got)
    for s, w in weights:
        for p in s:
            want[PIECES.index(p)] += w / total
    assert np.allclose(got, want)


def plain_log(word, model, column):
    """log P(word) by the sum over all last pieces, in logarithms."""
    at = [0.0]
    for j in range(1, len(word) + 1):
        terms = [at[i] + math.log(model.table[ids[word[i:j]], column]) for i in range(j) if word[i:j] in (ids := model.ids)]
        if word[j - 1] not in model.ids:
            terms.append(at[j - 1] + sum(math.log(model.table[len(model.ids) + b, column]) for b in word[j - 1].encode()))
        top = max(terms)
        at.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return at[-1]


def test_predictions_are_the_brute_force_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    plain = types.SimpleNamespace(ids={p: i for i, p in enumerate(model.pieces)}, table=model.table)
    rows = [(r.doc_id, r.text[:300]) for r in docs.orderBy("doc_id").limit(20).collect()] + [(900, "12 - ."), (901, None), (902, "語" * 40)]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        words = ["▁" + w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logs = [sum(plain_log(w, plain, k) for w in words) for k in range(len(model.languages))]
        top = max(logs)
        assert got[i].lang_pred == model.languages[logs.index(top)]
        assert math.isclose(got[i].score, 1 / sum(math.exp(x - top) for x in logs), rel_tol=1e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = entries.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0
