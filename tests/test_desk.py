"""The desk's writes, the chunkers that keep tables, and the index against the exact scan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ravine.functions import text as tx
from ravine.operators import chunking, desk, fusion, graph, vector
from ravine.plans import stand_ins as si
from ravine.plans.registry import QUERIES
from ravine.streaming import events as streams


def test_no_table_is_cut(spark):
    table = "| a | b |\n" * 60
    text = "Some words here. " * 60 + "\n\n" + table + "\nMore words follow. " * 60 + table
    chunks = chunking.split_keeping_tables(text, 100, 10)
    assert sum(table in c for c in chunks) == 2 and "" not in "".join(chunks)
    assert all("|" not in c.replace(table, "") for c in chunks)
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    parents = chunking.parents_and_children(df, 100, 10, 50, 5)[0].collect()
    assert all(text[r.start : r.end] == r.text for r in parents)


def test_page_chunks(spark):
    words = "A sentence is here. " * 80
    rows = [(1, 1, "x | t |" + words, ["| t |"], False), (1, 2, "", ["| u |"], True), (1, 3, "short", None, False), (2, 1, None, None, True)]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, text string, tables array<string>, is_scanned boolean")
    got = [(r.document_id, r.page_number, r.chunk_index, r.chunk_type) for r in chunking.page_chunks(pages).orderBy("document_id", "chunk_index").collect()]
    assert got == [(1, 1, 0, "table"), (1, 1, 1, "text"), (1, 1, 2, "text"), (1, 2, 3, "table"), (1, 2, 4, "image"), (2, 1, 0, "image")]


def test_sentence_boundaries(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", ". ", "?\n", "! ", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(t, rng.randrange(60)) for t in texts], "text string, at int")
    import re

    for r in df.withColumn("got", tx.sentence_boundary(F.col("text"), F.col("at"), 10)).collect():
        low = max(0, r.at - 10)
        ends = [low + m.end() for m in re.finditer(r"[.!?]\s+", r.text[low : min(len(r.text), r.at + 10)])]
        assert r.got == (min(ends, key=lambda e: (abs(e - r.at), e)) if ends else r.at)


def test_recording_twice_is_once(spark):
    customers = spark.createDataFrame([("c1", "+551"), ("c2", "+55 2"), ("c0", "+551")], "customer_id string, phone string")
    new = [(1, "c2", None), (2, "unknown", "+55 (1)"), (3, None, "+55 2"), (4, None, "+55-9"), (5, "unknown", "+559"), (6, None, None), (7, "gone", "+551"), (8, "c1", None)]
    calls = spark.createDataFrame(new, "call_id int, customer_id string, customer_phone string")
    known = spark.createDataFrame([(8,)], "call_id int")
    got, created, failed = desk.record_calls(calls, known, customers)
    assert {r.call_id: r.customer_id for r in got.collect()} == {1: "c2", 2: "c0", 3: "c2", 4: "new:+559", 5: "new:+559"}
    assert [(r.customer_id, r.phone) for r in created.collect()] == [("new:+559", "+559")] and {r.call_id for r in failed.collect()} == {6, 7}
    again, none, _ = desk.record_calls(calls, got.select("call_id").union(known), customers.union(created.select("customer_id", "phone")))
    assert again.count() == 0 and none.count() == 0


def test_attendees(spark):
    held = spark.createDataFrame([(1, "Dr. Ana Silva", "a", False), (2, "Dr. Silva", "b", True), (1, "Bo", "c", False)], "org_id int, attendee_name string, attendee_email string, is_default boolean")
    asked = spark.createDataFrame([(1, "silva"), (2, "silva"), (3, "Dr. "), (1, "bo"), (1, "x"), (1, "")], "org_id int, name string")
    got = {(r.org_id, r.name): r.attendee_email for r in desk.attendees(asked, held).collect()}
    assert got == {(1, "silva"): "a", (2, "silva"): "b", (3, "Dr. "): "b", (1, "bo"): "c"}


def test_scopes_and_gates(spark):
    rows = spark.createDataFrame([(1, 0.5, None, "a"), (2, 0.1, 1.0, "a"), (3, 0.1, None, "a"), (4, 0.9, None, "b")], "child_id int, semantic_score double, lexical_score double, category string")
    ids = lambda df: sorted(r.child_id for r in df.collect())
    assert ids(fusion.filtered(rows, 0.3)) == [1, 2, 4] and ids(fusion.filtered(rows, 0.3, category="b")) == [4] and ids(fusion.filtered(rows)) == [1, 2, 3, 4]
    docs = spark.createDataFrame([(1, "en"), (2, "pt")], "child_id int, collection string")
    assert ids(fusion.scoped(rows, docs, "child_id", collection="pt")) == [2] and ids(fusion.scoped(rows, docs, "child_id", collection=None)) == [1, 2, 3, 4]
    plans = spark.createDataFrame([(1, True, "MATCH"), (2, True, " "), (3, False, "MATCH"), (4, True, None)], "query_id int, requires_graph boolean, graph_query string")
    kin = rows.withColumnRenamed("child_id", "query_id")
    assert [r.query_id for r in fusion.gated(kin, plans).collect()] == [1] and fusion.gated(kin, plans, False).count() == 0


def test_graph_answers(spark):
    one = '{"nodes": [{"id": "a", "labels": ["X"], "properties": {"n": "1"}}, {"id": "b"}], "relationships": [{"startNode": "a", "endNode": "b"}], "chunk_ids": ["c", "c"]}'
    two = '{"nodes": [{"id": "a", "labels": ["Y"], "properties": {"n": "2"}}], "path": {"nodes": [{"id": "a"}, {"id": "b"}]}}'
    x = graph.parse_answers(spark.createDataFrame([(1, 0, one), (1, 1, two), (2, 0, "no json")], "query_id int, row int, json string"))
    assert [(r.id, r.label, r.place) for r in x["nodes"].orderBy("place").collect()] == [("a", "Y", 1), ("b", "unknown", 2)]
    assert [tuple(r) for r in x["edges"].collect()] == [(1, "a", "b", "RELATED_TO")] and x["chunks"].count() == 1
    assert [r.path for r in x["paths"].collect()] == [["a", "b"]]


def test_fan_out_keeps_the_first(spark):
    events = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "event_id int, channel string")
    subs = spark.createDataFrame([("x", "a"), ("y", "all"), ("z", "a"), ("z", "all"), ("w", "none")], "subscriber string, channel string")
    got = {}
    for r in streams.fan_out(events, subs, 10).collect():
        got.setdefault(r.subscriber, []).append(r.event_id)
    assert {k: sorted(v) for k, v in got.items()} == {"x": list(range(0, 20, 2)), "y": list(range(10)), "z": list(range(10))}


def test_plans_from_answers(spark):
    answers = ['{"keywords": ["x"], "weights": {"graph": 2.0}}', '```json\n{"intent": "factual"}\n```', "```\n{\"intent\": \"open\"}", 'Sure: {"requires_graph": true} ok', "nothing", None]
    rows = spark.createDataFrame([(i, "What is alpha", a) for i, a in enumerate(answers)], "query_id int, text string, answer string")
    got = {r.query_id: r for r in desk.parse_plans(rows).collect()}
    assert got[0].keywords == ["x"] and got[0].weights == {"graph": 2.0} and got[0].intent == "general"
    assert [got[i].intent for i in (1, 2, 3, 4, 5)] == ["factual", "open", "general", "general", "general"]
    assert [got[i].requires_graph for i in (3, 4)] == [True, False] and got[4].keywords == ["alpha"] and set(got[5].weights) == {"lexical", "semantic", "graph"}


def test_stems(spark):
    row = spark.range(1).select(tx.stemmed_terms(F.lit("Queries of boxes, glass buses; shoes aies s")).alias("t")).first()
    assert row.t == "query boxe glass buse shoes aie "


def test_a_reference_is_cut_like_its_table(spark):
    """Parents around a reference, with the table put back, are the parents around the table itself."""
    table = "".join(f"| {k} | supplier |\n" for k in range(400))
    texts = [" ".join(f"word{i}" for i in range(n)) + "." for n in (0, 3, 150, 700)] + ["line\n" * 300, "", "| not a table"]
    ids = list(enumerate(texts))
    frame = lambda middle: spark.createDataFrame([(i, f"{t}\n\n{middle}\n{t}") for i, t in ids], "document_id int, text string")
    parents = lambda df: chunking.parents_and_children(df, parent=200, parent_overlap=20)[0]
    key = F.lit(7)
    want = [(r.parent_id, r.text) for r in parents(frame(table)).collect()]
    short = parents(frame(spark.range(1).select(chunking.reference(key)).first()[0] + "\n"))
    got = short.select("parent_id", chunking.put_back(F.col("text"), key, F.lit(table.rstrip("\n"))).alias("text")).collect()
    assert sorted((r.parent_id, r.text) for r in got) == sorted(want) and any(table.rstrip("\n") in t for _, t in want)


def test_tables_of_suppliers_are_not_split_with_each_document(spark):
    """No table of suppliers goes through the splitter; it is joined to the parents."""
    plan = QUERIES["tables_kept_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow")
    assert above.count("Join Inner") == 1 and "Join" not in below


def test_a_table_is_put_back_whole_at_every_reference(spark):
    """Signs of patterns in the text or the table are no patterns, and a text without a reference stays."""
    df = spark.createDataFrame([("a.*$1 | table 3 | b\n| table 3 |", 3), ("| table 33 |", 3), ("plain", 3), ("", 3)], "text string, key int")
    got = [r[0] for r in df.select(chunking.put_back(F.col("text"), F.col("key"), F.lit("| $0 \\E |\n| x |"))).collect()]
    assert got == ["a.*$1 | $0 \\E |\n| x | b\n| $0 \\E |\n| x |", "| table 33 |", "plain", ""]
