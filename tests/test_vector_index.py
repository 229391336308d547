"""The stored vector index against exact scans."""

from __future__ import annotations

import numpy as np
import pytest

from ravine.operators import vector, vector_index
from ravine.operators.vector_index import VectorIndex
from ravine.plans import stand_ins as si


def pairs(df):
    return {(r.query_id, r.child_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nine_of_ten_for_a_tenth_of_the_pairs(spark, sf):
    d = f"/root/testdata/{sf}"
    index, asked, held = si.vector_index(spark, d), si.asked_vectors(spark, d), si.vectors(spark, d)
    exact, got = pairs(vector.similar(asked, held, 10)), index.search(asked, 10)
    assert len(pairs(got) & exact) >= 0.9 * len(exact)
    assert index.model.rerank <= 0.1 * held.count()
    assert index.table.read().count() == held.count() and not index.add(held, index.table.manifest()["commits"][0])


def made(spark, seed, n, first=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 10)) + 4 * rng.normal(size=(8, 10))[rng.integers(0, 8, n)]
    x[0], x[1:4] = 0, x[1]
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(x)] + [(first + n, None)]
    return spark.createDataFrame(rows, "child_id long, embedding array<float>")


def test_append_and_exact_when_everything_is_visited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "UNIT", 16)  # cells in several units, queries in several groups
    monkeypatch.setattr(vector_index, "QUERIES", 5)
    index = VectorIndex(spark, f"file://{tmp_path}/v", 4)
    one, two = made(spark, 1, 300), made(spark, 2, 60, 1000)
    index.add(one, "one")
    index.add(two, "two")
    both, asked = one.union(two), one.where("child_id % 20 = 5").union(two.limit(5)).withColumnRenamed("child_id", "query_id")
    rows = lambda df: sorted((r.query_id, r["rank"], r.child_id, round(r.similarity, 9)) for r in df.collect())
    assert rows(index.search(asked, 7, probes=len(index.model.centres), rerank=10_000)) == rows(vector.similar(asked, both, 7))
    near = pairs(index.search(asked, 7))
    assert len(near & pairs(vector.similar(asked, both, 7))) >= 0.85 * len(near)
    with pytest.raises(Exception, match="dimensions"):
        index.add(spark.createDataFrame([(5000, [1.0, 2.0])], "child_id long, embedding array<float>"), "three")
    assert index.table.read().count() == 360


def test_empty(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v", 4)
    index.add(made(spark, 1, 5).where("false"), "none")
    assert index.search(made(spark, 1, 5).withColumnRenamed("child_id", "query_id").where("false"), 3).collect() == []
