"""What a task of the suffix sort holds beside its batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from ravine.llm import suffix_array as sa


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_anchors_of_a_batch_are_found_in_small_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh", k=200_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def scan():
        for _, data, starts, ends in sa._pieces(batch, 400):
            sa.runs_of(np.frombuffer(data, np.uint8), starts, ends, 400)

    assert peak_mb(scan) < 80


def test_a_batch_of_many_buckets_is_sorted_in_blocks():
    rng = random.Random(6)
    bodies = ["".join(rng.choices("ab", k=600)).encode() for _ in range(4000)]
    data = [x for body in bodies for x in (body, body[:500] + b"c" * 100)]
    n = len(data)
    columns = {"doc_id": np.arange(n), "hash": np.arange(n), "bucket": np.arange(n) // 2, "first": np.full(n, 7), "data": data}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    got = []
    assert peak_mb(lambda: got.extend(sa._sorted_spans(400, "bigint")(iter([batch.slice(0, 4999), batch.slice(4999)])))) < 150
    assert sorted(r for b in got for r in zip(*b.to_pydict().values())) == [(i, i, 7, 507) for i in range(n)]
