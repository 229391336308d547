"""Exact vector search by units: ties, copies, nulls, rounding."""

from __future__ import annotations

import random

import pytest

from ravine.operators import vector
from ravine.operators.lexical import top
from pyspark.sql import functions as F

from ravine.functions import vectors as vx


def plain(queries, chunks, k, by=None, places=None):
    """All pairs, as the definition has it."""
    asked = vector.unit(queries).select("query_id", *(by or []), F.col("embedding").alias("asked"))
    held = vector.unit(chunks)
    scored = (held.join(asked, by) if by else held.crossJoin(asked)).select("query_id", "child_id", vx.dot(F.col("asked"), F.col("embedding")).alias("similarity"))
    return top(scored if places is None else scored.withColumn("similarity", F.round("similarity", places)), "similarity", k)


@pytest.mark.parametrize("by,places", [(None, None), (["label"], None), (None, 1)])
def test_units_equal_all_pairs(spark, monkeypatch, by, places):
    monkeypatch.setattr(vector, "UNIT", 50)
    rng = random.Random(5)
    draw = lambda: [rng.gauss(0, 1) for _ in range(6)]
    copied = draw()
    rows = [(i, rng.choice([copied, draw()]), rng.choice([1, 2, None])) for i in range(180)]
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (903, [float("nan")] * 6, 1), (904, [1.0, 2.0], 2)]
    chunks = spark.createDataFrame(rows, "child_id long, embedding array<double>, label int")
    queries = chunks.where("child_id % 9 = 0 or child_id > 900").withColumnRenamed("child_id", "query_id")
    shown = lambda df: sorted(repr((r.query_id, r.child_id, r.similarity, r["rank"])) for r in df.collect())
    assert shown(vector.similar(queries, chunks, 7, by=by, places=places)) == shown(plain(queries, chunks, 7, by, places))


def test_pairs_stay_out_of_the_shuffle(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0])], "child_id long, embedding array<double>")
    plan = vector.similar(chunks.withColumnRenamed("child_id", "query_id"), chunks, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
