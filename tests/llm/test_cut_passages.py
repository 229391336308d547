"""Benchmark passages that lack leading bytes, at the start of a text behind a clean one."""

from __future__ import annotations

import random

import pytest

from ravine.llm import decontaminate

CLEAN = "a clean text that holds nothing of the benchmark at all"


@pytest.mark.parametrize("lost", [0, 1, 5, 12])
def test_a_cut_passage_is_its_own_texts(spark, lost):
    rng = random.Random(lost)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
    texts = [(1, CLEAN), (2, item[lost:] + " and more words"), (3, CLEAN), (4, "some words " + item[: 120 - lost]), (5, CLEAN)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.edits) for r in decontaminate.find_passages(docs, bench).collect()}
    assert got == {2: (0, 120 - lost, lost), 4: (11, 131 - lost, lost)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {1, 3, 5}
