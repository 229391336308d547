"""Byte-string dedup against a count of all strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ravine.llm import suffix_array as sa


def brute(docs, length):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        spans = sa.merged([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out.append((d, len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    docs = []
    for i in range(50):
        at = rng.randrange(2500)
        x, y = base[at : at + rng.randint(50, 500)], "".join(rng.choice("abcd") for _ in range(rng.randint(0, 300)))
        docs.append((i, rng.choice([x + y, y + x, y + x + y, x + x, y, "", None, "a" * rng.randint(100, 400)])))
    hot = "".join(rng.choice("xyz") for _ in range(400))
    edge = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    return docs + docs[:2] + [(100 + i, edge("pq", 60) + hot + edge("rs", 90)) for i in range(30)]


@pytest.mark.parametrize("bucket,seed", [(512, 1), (8, 2)])
def test_removes_exactly_what_repeats(spark, monkeypatch, bucket, seed):
    monkeypatch.setattr(sa, "BUCKET", bucket)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sa.remove_repeats(df, 128).collect())
    assert got == brute(docs, 128)


def test_the_cover_covers():
    for v in (8, 16, 32, 64):
        cover, delta = sa.difference_cover(v)
        for i in range(v):
            for j in range(v):
                assert (i + delta[i, j]) % v in cover and (j + delta[i, j]) % v in cover


def test_a_text_in_several_pieces(monkeypatch):
    monkeypatch.setattr(sa, "_STEP", 1000)
    import pyarrow as pa

    text = "".join(random.Random(1).choice("abc") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "short", None])], names=["text"])
    seen = np.zeros(5000, int)
    for rows, data, starts, ends in sa._pieces(batch, 128):
        anchor, first, last = sa.runs_of(np.frombuffer(data, np.uint8), starts, ends, 128)
        for f, e in zip(first, last):
            k = np.searchsorted(ends, f, side="right")
            seen[rows[k][1] + f - starts[k] : rows[k][1] + e - starts[k] + 1] += 1
    assert (seen[: 5000 - 127] == 1).all() and (seen[5000 - 127 :] == 0).all()


def test_the_query_over_a_whole_table(spark):
    from ravine.llm.entries import op10_suffix_array_dedup

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_suffix_array_dedup(spark, sf_dir).collect()
    expected = brute(docs, 400)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert any(r[2] for r in expected)


def test_a_passage_across_the_pieces_of_a_long_text(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage, cut = letters(900), sa._STEP - 300
    long = letters(cut) + passage + letters(70_000)
    df = spark.createDataFrame([(1, long), (2, "é" + passage[:500]), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in sa.remove_repeats(df).collect()}
    assert got[1] == (500, 1, (long[:cut] + long[cut + 500 :]).encode())
    assert got[2] == (500, 1, "é".encode()) and got[3] == got[4] == (0, 0, b"")
