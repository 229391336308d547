"""Decontamination against alignments of every segment with every whole text, and its edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ravine.llm import decontaminate as dc


def least_edits(piece: bytes, text: bytes) -> int:
    """The fewest edits with which piece occurs anywhere in text."""
    body, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for c in piece:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (body != c))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def brute(texts, items, error=0.1):
    out = set()
    for d, text in texts:
        body = dc.normal(text)
        for i, item in items:
            for s in dc.segments(i, item, error):
                short = len(s.data) < dc.Q
                if (b" " + s.data + b" " in b" " + body + b" ") if short else (body and least_edits(s.data, body) <= s.budget):
                    out.add((d, i))
    return out


def edited(rng, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        k, o = rng.randrange(len(out)), rng.random()
        out[k : k + (o < 0.6)] = [] if o < 0.3 else [rng.choice(alphabet)]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["abcdefghijk lmnop", "ab "])
def test_finds_exactly_what_alignment_finds(alphabet):
    rng = random.Random(len(alphabet))
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([2, 5, 7, 8, 9, 10, 13, 19, 20, 29, 30, 39, 41, 77, 119, 120, 121, 180, 230])]
    items += [(100, items[14][1]), (101, "-" * 300), (102, None), (103, "")]
    texts = []
    for d in range(60):
        _, item = rng.choice(items[:-2])
        at = rng.randrange(max(1, len(item) - 130)) if len(item) > 130 else 0
        part = edited(rng, item[at : at + 130], rng.randint(0, 14) if len(item) > 60 else rng.randint(0, 3), alphabet)
        texts.append((d, make(rng.randint(0, 60)) + rng.choice([" ", ""]) + part + rng.choice([" ", ""]) + make(rng.randint(0, 60))))
    index = dc.Index([s for k, (_, t) in enumerate(items) for s in dc.segments(k, t, 0.1)])
    found = {(texts[t][0], items[i][0]) for t, i, *_ in dc.places([dc.normal(t) for _, t in texts], index)}
    assert found == brute(texts, items)
    assert 10 < len(found)


def test_the_query_over_a_table(spark, tmp_path):
    from ravine.llm.entries import op9_benchmark_decontamination

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(12)
    bench = spark.read.parquet(f"{source}/benchmark.parquet").orderBy("item_id").limit(8)
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    texts += [(1000 + i, texts[i][1][:300] + " " + edited(random.Random(i), t, len(t) // 15, "xyz") + " tail") for i, t in items]
    texts += [(2000, None), (2001, ""), (2002, items[0][1]), (2002, "clean"), (None, items[1][1]), (None, "clean")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_items for r in op9_benchmark_decontamination(spark, str(tmp_path)).collect()}
    expected = {}
    for d, i in brute(texts, items):
        expected.setdefault(d, set()).add(i)
    assert got == {d: len(x) for d, x in expected.items()} and {2002, None} < set(got)


def test_rows_are_judged_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(None, item, 1), (None, "clean", 2), (7, "also clean", 3), (7, "x " + item.upper(), 4), (8, None, 5), (9, "", 6), (7, "also clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text int")
    bench = spark.createDataFrame([("q", item), (None, None)], "item_id string, text string")
    assert sorted(r._text for r in dc.decontaminate(docs, bench).collect()) == [2, 3, 5, 6, 7]
    assert dc.decontaminate(docs, bench.where("false")).count() == 7


def test_memory_does_not_follow_repetitions():
    rng = random.Random(1)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(90)) + "-" * 300 + str(i) for i in range(20)]
    index = dc.Index([s for i, t in enumerate(items) for s in dc.segments(i, t, 0.1)])
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(dc.places([b"-" * 20_000, b"x" * 20_000], index))
    assert {f[:2] for f in found} == {(0, i) for i in range(20)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_a_passage_across_the_pieces_of_a_long_text():
    rng = random.Random(2)
    item = "".join(rng.choices("abcdefgh", k=120))
    index = dc.Index(dc.segments(0, item, 0.1))
    letters = "".join(rng.choices("ijklmnop", k=dc._STEP * 2))
    for at in (dc._STEP - 60, dc._STEP + 10, dc._STEP * 2):
        text = (letters[:at] + item + letters[at:]).encode()
        assert [(t, i, s, e, d) for t, i, s, e, d in dc.places([b"short", text], index)] == [(1, 0, at, at + 120, 0)]
