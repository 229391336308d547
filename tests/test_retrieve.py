"""Planned retrieval, and the boundaries of models."""

from __future__ import annotations

import pytest

from ravine.operators import boundaries, fusion, retrieve


def test_plans_weigh_and_gate(spark):
    queries = spark.createDataFrame([(1, "who knows alpha"), (2, "alpha beta"), (3, "nothing")], "query_id int, text string")
    plans = retrieve.planned(queries)
    told = {r.query_id: r for r in plans.collect()}
    assert told[1].requires_graph and told[1].weights["graph"] == 1.0 and not told[2].requires_graph and told[2].weights["graph"] == 0.5
    row = lambda *r: spark.createDataFrame(list(r), "query_id int, child_id int, rank int, score double")
    channels = {"lexical": row((1, 10, 1, 0.9), (2, 10, 1, 0.9)), "semantic": row((1, 11, 1, 0.8)), "graph": row((1, 12, 1, 1.0), (2, 12, 1, 1.0))}
    chunks = spark.createDataFrame([(10, 1, "alpha beta"), (11, 1, "gamma"), (12, 2, "who knows alpha"), (13, 9, "alone")], "child_id int, parent_id int, text string")
    parents = spark.createDataFrame([(1, "alpha beta gamma", "h1")], "parent_id int, text string, heading string")
    results, status = retrieve.retrieve(queries, plans, channels, chunks, parents, retrieve.Limits(refuse_under=0.1, alpha=0.0))
    got = {(r.query_id, r.child_id): r for r in results.collect()}
    # the graph answers only the query that asks for it; a chunk without a parent is judged by its own text
    assert set(got) == {(1, 10), (1, 11), (1, 12), (2, 10)}
    assert got[1, 12].score == pytest.approx(0.5 * round(1.0 / 61, 9) + 0.2, abs=1e-6) and got[1, 12].heading is None
    assert got[2, 10].score == pytest.approx(0.5 * round(0.7 / 61, 9) + 0.2, abs=1e-6) and got[2, 10].heading == "h1"
    assert {(r.query_id, r.refused, r.reason) for r in status.collect()} == {(1, False, None), (2, False, None), (3, True, "no candidates")}


def test_a_plan_may_leave_weights_out(spark):
    row = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 1, 1.0)], "query_id int, child_id int, rank int, score double")
    plans = spark.createDataFrame([(1, {"lexical": 2.0})], "query_id int, weights map<string,double>")
    got = {r.query_id: r.rrf_score for r in fusion.fuse({"lexical": row, "graph": row}, {"graph": 3.0}, plans=plans).collect()}
    assert got == {1: pytest.approx(5 / 61), 2: pytest.approx(4 / 61)}


def test_failed_batches_become_rows(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts if t != "last"]

    rows = [(i, t) for i, t in enumerate(["a", "bad", "ccc", None, "dd", "", "e", "last"])]
    df = spark.createDataFrame(rows, "child_id int, text string").coalesce(1)
    got = {r.child_id: (r.embedding, r.error) for r in boundaries.embedded(df, embed, batch=2).collect()}
    failed = (None, "ValueError: bad text")
    assert got == {0: failed, 1: failed, 2: ([3.0], None), 3: (None, "no text"), 4: ([2.0], None), 5: ([0.0], None), 6: ([1.0], None), 7: (None, "no answer")}
    zero = {r.child_id: r.embedding for r in boundaries.embedded(df, embed, batch=2, zero=1).collect()}
    assert zero[0] == [0.0] and zero[3] == [0.0] and boundaries.embedded(df.where("false"), embed).count() == 0


def test_scorer(spark):
    rows = [(1, i, "q", f"c{i}", i / 10) for i in range(8)] + [(2, 1, None, None, 0.5)]
    df = spark.createDataFrame(rows, "query_id int, child_id int, question string, content string, rrf_score double").coalesce(1)
    short = lambda pairs: [0.9][: len(pairs)]
    got = boundaries.rescored(df, short, most=3, batch=2).collect()
    assert {(r.query_id, r.child_id) for r in got} == {(1, 7), (1, 6), (1, 5), (2, 1)} and {r.rerank_score for r in got} == {0.9, 0.5}

    def broken(pairs):
        raise RuntimeError("down")

    assert {(r.rerank_score, r.error) for r in boundaries.rescored(df, broken).collect()} == {(None, "RuntimeError: down")}
