"""The scan for repeated paragraphs and passages hashes many texts together."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ravine.llm import buckets, substring_dedup


class Scan:
    """A table whose mapInArrow() is run here, on one batch."""

    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def __init__(self, texts):
        columns = [pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())]
        self.batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "text"])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return pa.Table.from_batches(run(iter([self.batch]))).to_pylist()


def texts(n):
    rng = random.Random(n)
    line = lambda: " ".join(rng.choices(["a", "B", "é", "word", "İx", "of"], k=rng.randint(0, 60)))
    return [None, "", "short"] + ["\n".join(line() for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_shingles_are_hashed_together(monkeypatch):
    calls = []
    plain = buckets.shingle_hashes
    for module in (buckets, substring_dedup):
        monkeypatch.setattr(module, "shingle_hashes", lambda one, width: calls.append(width) or plain(one, width))
    rows = substring_dedup._scanned(Scan(texts(200)), 25, 5)
    assert sum(r["paragraph"] is not None for r in rows) > 300
    assert len(calls) < 10


def test_each_text_has_its_own_rows():
    """Texts scanned together give what each gives alone: no shingle or sample spans two texts."""
    docs = texts(60)
    together = substring_dedup._scanned(Scan(docs), 25, 5)
    alone = [r | {"doc_id": i, "hash": i} for i, x in enumerate(docs) for r in substring_dedup._scanned(Scan([x]), 25, 5)]
    order = lambda r: (r["doc_id"], r["at"] is not None, r["at"] or 0, r["paragraph"] or 0)
    assert sorted(together, key=order) == sorted(alone, key=order)
    assert any(r["at"] is not None for r in together)


@pytest.mark.parametrize("n", [0, 1, 5, 19, 20, 300])
def test_minima_and_hashes(n):
    values = np.random.default_rng(n).integers(0, 6, n, dtype=np.uint64)
    windows = [values[k : k + 19] for k in range(max(n - 18, min(n, 1)))]
    assert substring_dedup.leftmost_minima(values, 19).tolist() == [k + int(w.argmin()) for k, w in enumerate(windows)]
    words = [b"w%d" % x for x in values]
    assert buckets.word_hashes(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]


def test_of_equal_stretches_the_smallest_holder_is_taken():
    words = [b"w%d" % i for i in range(40)]
    hit = lambda holder: (holder, 1, 0, 0, 64, 0, b" ".join(words))
    assert substring_dedup._repeats(words, [hit(7), hit(3), hit(5)]) == [(3, 0, 40)]
    assert substring_dedup._repeats(words[:39] + [b" "], [hit(7)]) == [(7, 0, 39)]
    gone = b" ".join(words[:35] + [b""] * 5)
    assert substring_dedup._repeats(words[:35] + [b" "] * 5, [(7, 1, 0, 0, 64, 0, gone)]) == [(7, 0, 35)]
