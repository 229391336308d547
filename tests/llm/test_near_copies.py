"""The pipeline's near-duplicate stage against all pairs, on planted copies."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from ravine.llm import buckets
from tests.llm.test_links import smallest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("members", [buckets.MEMBERS, 2])
def test_edited_copies_go(spark, monkeypatch, members):
    monkeypatch.setattr(buckets, "MEMBERS", members)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [[word() for _ in range(rng.randint(60, 400))] for _ in range(60)]
    for base in texts[:60]:
        for _ in range(3):
            copy, least = list(base), rng.uniform(0.7, 0.95)
            while similarity(base, copy) > least:
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(links) > 90
    want = {i for i, c in enumerate(smallest(len(texts), links, range(len(texts)))) if i == c}
    rows = [(i, " ".join(t).upper() if i % 2 else " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, rows[0][1], "en", "a", 1), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert 1000 in got and len(got) == len(set(got))
    # bands find a pair at the threshold with probability 0.998
    got = set(got) - {1000}
    assert got >= want and len(got - want) <= 2


def test_unlike_texts_stay_whatever_their_ids(spark):
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcde"]
    rows = [(i, t, "en", "a", 1) for i, t in zip((None, None, None, 7, 7), texts)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.text for r in got) == texts
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
