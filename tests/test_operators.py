"""Operators on small inputs with known results."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravine.functions import text as tx
from ravine.functions import vectors as vx
from ravine.operators import chunking, fusion, graph, ingest, kpi, lexical, relational


def value(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def channel(spark, rows):
    return spark.createDataFrame([(1, c, r, s) for c, r, s in rows], "query_id int, child_id string, rank int, score double")


def test_weighted_reciprocal_ranks(spark):
    one = {n: channel(spark, [("x", r, 0.9)]) for n, r in (("lexical", 1), ("semantic", 2), ("graph", 3))}
    got = fusion.fuse(one, {"lexical": 0.7, "semantic": 0.8, "graph": 1.0}).first()
    assert math.isclose(got.rrf_score, 0.7 / 61 + 0.8 / 62 + 1.0 / 63) and got.sources == ["graph", "lexical", "semantic"]
    alone = {n: channel(spark, [(n, 1, 0.5)]) for n in ("lexical", "semantic", "graph")}
    order = fusion.fuse(alone, {"lexical": 0.7, "semantic": 0.8, "graph": 1.0}).orderBy(F.desc("rrf_score")).collect()
    assert [r.child_id for r in order] == ["graph", "semantic", "lexical"]
    both = {"lexical": channel(spark, [("a", 1, 1.0)]), "semantic": channel(spark, [("a", 1, 1.0)])}
    assert math.isclose(fusion.fuse(both, {"lexical": 2.0, "semantic": 0.5}).first().rrf_score, 2.5 / 61)


def test_relative_denoising_and_refusal(spark):
    rows = channel(spark, [("a", 1, 0.95), ("b", 2, 0.2)])
    assert [r.child_id for r in fusion.relative(rows, "score", 0.6, 0.5).collect()] == ["a"]
    assert fusion.relative(rows, "score", 0.99).count() == 0
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {r.query_id: (r.refused, r.reason is None) for r in fusion.refusals(asked, rows).collect()} == {1: (False, True), 2: (True, False)}


def test_conformal_cut(spark):
    rows = channel(spark, [("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 4.0), ("d", 4, 8.0)])
    assert {r.child_id for r in fusion.conformal(rows, "score").collect()} == {"c", "d"}
    assert fusion.conformal(rows.where("rank < 3"), "score").count() == 2


def test_min_max(spark):
    assert [r.normalized for r in fusion.min_max(channel(spark, [("a", 1, 3.0), ("b", 2, 3.0)]), "score").collect()] == [1.0, 1.0]


def test_table_counts_more_for_data_questions(spark):
    score = lambda t: value(spark, fusion.lightweight_score(F.lit("show me the data table"), F.lit("numbers"), F.lit(0.5), F.lit(0.5), F.lit(t)))
    assert score(True) > score(False)


@pytest.mark.parametrize(
    "answer,want", [("Yes.", 0.9), ("sim", 0.9), ("no", 0.1), ("no, but yes", 0.6), ("maybe yes", 0.7), ("I know", 0.3), ("hm", 0.5), ("", 0.5)]
)
def test_yes_no(spark, answer, want):
    assert value(spark, tx.yes_no_score(F.lit(answer))) == want


def test_yes_probability(spark):
    assert math.isclose(value(spark, tx.yes_probability(F.lit(-0.1), F.lit(-2.0))), 1 / (1 + math.exp(-1.9)))
    assert value(spark, tx.yes_probability(F.lit(-1.0), F.lit(None).cast("double"))) == 1.0


def test_text_functions(spark):
    assert value(spark, tx.token_estimate(F.lit("a" * 403))) == 100
    assert value(spark, tx.content_hash(F.lit(" A  b\n"))) == value(spark, tx.content_hash(F.lit("a b")))
    assert value(spark, tx.keywords(F.lit("What is the (BEST) best, way?"))) == ["best", "way"]
    assert value(spark, tx.intent(F.lit("How to compare"))) == "procedural"
    assert value(spark, tx.requires_graph(F.lit("the whole"))) is True
    assert value(spark, tx.section_heading(F.lit("## Title \nbody"))) == "Title"
    assert value(spark, tx.section_heading(F.lit("1. First step\nbody"))) == "1. First step"
    assert value(spark, tx.outcome(F.lit("I am not interested"))) == "interested"
    assert value(spark, tx.sentiment(F.lit("thanks, great, perfect"))) == "positive"
    assert value(spark, tx.phone_clean(F.lit("+1 (55) 2-3"))) == "+15523" and value(spark, tx.e164(F.lit("1-2"))) == "+12"
    assert value(spark, tx.markdown_tables(F.lit("x\n|a|b|\n|-|-|\n|1|2|\ny\n|z|\n"))) == ["|a|b|\n|-|-|\n|1|2|\n"]
    table = "| a | b | c | d | e | f |\n|---|---|---|---|---|---|\n| 1 | 2 | 3 | 4 | 5 | 6 |"
    assert value(spark, tx.table_context(F.lit(table))) == "Table with columns: a, b, c, d, e, ... (6 columns). 1 rows."
    assert value(spark, tx.rows_to_markdown(F.array(F.array(F.lit("h"), F.lit("i")), F.array(F.lit("x"))))) == "| h | i |\n| --- | --- |\n| x |  |"
    assert value(spark, tx.ocr_confidence(F.lit("short"))) == 0.1
    assert math.isclose(value(spark, tx.ocr_confidence(F.lit("a" * 120))), 1.0)
    assert value(spark, tx.labelled(("Section", F.lit("s")), ("Table", F.lit(None).cast("string")), ("", F.lit("text")))) == "Section: s\ntext"


def test_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert value(spark, vx.cosine(arr(1, 0), arr(0, 0))) == 0.0
    assert math.isclose(value(spark, vx.cosine(arr(1, 1), arr(2, 2))), 1.0)
    assert value(spark, vx.normalized(arr(0, 0))) == [0.0, 0.0]
    assert value(spark, vx.matryoshka(arr(3, 4, 9), 2)) == [0.6, 0.8]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#-", max_size=900), st.integers(5, 40), st.integers(0, 4))
def test_split_text_loses_nothing_and_fits(text, size, overlap):
    chunks = chunking.split_text(text, size, overlap)
    assert all(len(c) // 4 <= size + overlap or len(c) <= size * 8 for c in chunks)
    at = 0
    for c in chunks:
        at = text.find(c, max(0, at - len(c) - 4 * overlap - 8))
        assert at >= 0
    if overlap == 0 and any(s in text for s in (" ", "\n")):
        assert "".join(chunks).replace(" ", "").startswith("".join(chunks).replace(" ", "")[:5])


def test_split_text_ends_on_text_without_separators():
    chunks = chunking.split_text("x" * 10_000, 100, 20)
    assert chunks[-1].endswith("x") and sum(map(len, chunks)) >= 10_000 and max(map(len, chunks)) <= 400


def test_split_text_overlaps_by_whole_pieces():
    words = [f"w{i:02d} " for i in range(60)]
    chunks = chunking.split_text("".join(words), 20, 5)
    assert all(b.startswith(a[-20:][a[-20:].index("w") :]) for a, b in zip(chunks, chunks[1:]))


def test_pack_words_and_overlap():
    chunks = chunking.pack_words("one two. three four. " * 30, 20)
    assert all(len(c) // 4 <= 20 for c in chunks)
    assert chunking.with_overlap(["a" * 100, "b"], 5) == ["a" * 100, "a" * 20 + " b"]
    assert chunking.window_chunks("short") == ["short"]
    assert all(len(c) <= 1000 for c in chunking.window_chunks("A sentence here. " * 200))


def test_parents_and_children(spark):
    text = "# Head\n\n" + "para one is here. " * 150 + "\n\n# Next\n\n" + "para two. " * 150
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    parents, children = chunking.parents_and_children(df, 200, 20, 50, 10)
    p, c = parents.collect(), children.collect()
    assert {r.document_id for r in p} == {"d"} and {r.parent_id for r in c} == {r.parent_id for r in p}
    assert {r.section_heading for r in p} == {"Head", "Next"}
    by = {r.parent_id: r.text for r in p}
    assert all(by[r.parent_id][r.start_char_offset : r.end_char_offset] == r.text for r in c)
    assert all(text[r.start : r.end] == r.text for r in p)


def test_pages_and_headings(spark):
    pages = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("page")) for a, b, p in ((0, 10, 1), (10, 20, 2))))
    assert [value(spark, chunking.page_at(pages, F.lit(x))) for x in (0, 10, 15, 99)] == [1, 1, 2, 1]


def test_extraction(spark):
    answer = '```json\n{"entities": [{"name": "Ada"}, {"name": ""}, {"name": "Bob", "type": "PERSON", "canonical_name": "bob"}], "relations": [{"subject": "Ada", "object": "bob", "type": "KNOWS"}, {"subject": "Ada", "object": "nobody"}]}\n```'
    rows = spark.createDataFrame([(1, answer), (2, "no json")], "parent_id int, json string")
    entities, relations = ingest.parse_extraction(rows)
    named = entities.withColumn("entity_id", F.lower("name"))
    assert {(r.name, r.entity_type) for r in entities.collect()} == {("Ada", "UNKNOWN"), ("Bob", "PERSON")}
    assert [(r.src, r.dst, r.confidence) for r in ingest.resolve_relations(relations, named).collect()] == [("ada", "bob", 1.0)]
    kids = spark.createDataFrame([(1, "c1", "Ada was here"), (1, "c2", "nobody")], "parent_id int, child_id string, text string")
    assert ingest.mention_rows(named, kids).count() == 4 and ingest.mention_rows(named, kids, True).count() == 1
    known = spark.createDataFrame([("ada", "x")], "canonical_name string, entity_id string")
    assert ingest.upsert_entities(named.select("canonical_name", "entity_id").withColumn("canonical_name", F.lower("canonical_name")), known, ["canonical_name"], "entity_id").count() == 2


def test_ingest_twice_is_once(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other")], "document_id int, text string")
    nothing = spark.createDataFrame([], "org_id int, hash string"), spark.createDataFrame([], "org_id int, content_hash string")
    first = ingest.ingest(docs, *nothing, 7)
    assert first["documents"].count() == 2 and first["children"].count() == 2
    again = ingest.ingest(docs, first["documents"].select("org_id", "hash"), first["children"].select("org_id", "content_hash"), 7)
    assert again["children"].count() == 0


def test_cover_density(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha x x beta y alpha beta"), (3, "alpha")], "child_id int, text string")
    asked = spark.createDataFrame([(1, "Beta alpha")], "query_id int, text string")
    got = {r.child_id: r.score for r in lexical.cover_density(asked, chunks).collect()}
    # covers of 2: alpha x x beta (1/3), beta y alpha (1/2), alpha beta (1)
    assert got.keys() == {1, 2} and math.isclose(got[1], 1.0) and math.isclose(got[2], 1 / 3 + 1 / 2 + 1)


def test_graph_paths(spark):
    rel = spark.createDataFrame([(a, b, "R") for a, b in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"))], "src string, dst string, relation_type string")
    pairs = spark.createDataFrame([("a", "e"), ("a", "f"), ("c", "c"), ("d", "b")], "src string, dst string")
    assert {(r.src, r.dst): r.distance for r in graph.shortest_paths(pairs, rel).collect()} == {("a", "e"): 4, ("c", "c"): 0, ("d", "b"): 2}


def test_free_slots_over_midnight(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    slots = spark.range(1).select(F.lit(1).alias("k"), F.explode(F.array(F.struct(at("2024-01-01 23:30").alias("start"), at("2024-01-02 00:30").alias("end")), F.struct(at("2024-01-02 01:00").alias("start"), at("2024-01-02 02:00").alias("end")))).alias("s")).select("k", "s.*")
    busy = spark.range(1).select(F.lit(1).alias("k"), at("2024-01-02 00:00").alias("start"), at("2024-01-02 01:00").alias("end"))
    assert [str(r.start) for r in relational.free_slots(slots, busy, "k").collect()] == ["2024-01-02 01:00:00"]


def test_unreadable_schedules_allow(spark):
    gate = lambda a: value(spark, relational.open_hours(F.lit("2024-01-01 12:00").cast("timestamp"), F.array(F.lit("mon")), F.lit(a), F.lit("18:00")))
    assert gate("09:00") is True and gate("13:00") is False and gate("soon") is True


def test_quality(spark):
    ranked = spark.createDataFrame([(1, c, r) for r, c in enumerate("abcd", 1)], "query_id int, child_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id int, child_id string")
    got = kpi.ranking_quality(ranked, relevant, 4).first()
    best = 1 + 1 / math.log2(3) + 0.5
    assert math.isclose(got.ndcg, (1 / math.log2(3) + 1 / math.log2(5)) / best) and got.mrr == 0.5 and got.precision == 0.5 and math.isclose(got.recall, 2 / 3)


def test_cover_density_places_only_whole_matches(spark):
    """A query's common words bring no places of chunks that lack another of its words."""
    from ravine.operators import lexical

    chunks = spark.createDataFrame([(i, "the " * 50) for i in range(20)] + [(99, "the red the house")], "child_id long, text string")
    asked = spark.createDataFrame([(1, "the red house")], "query_id long, text string")
    got = lexical.cover_density(asked, chunks)
    assert [(r.child_id, r.score) for r in got.collect()] == [(99, 1.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "whole-" in str(got.inputFiles())


def test_chunks_are_made_of_a_few_texts_at_a_time():
    """A batch is cut by bytes of text; nulls and long texts keep their places."""
    import pyarrow as pa

    texts = ["a" * 300, None, "b" * 5000, "", "c" * 900, "d" * 900]
    batch = pa.RecordBatch.from_pydict({"document_id": list(range(6)), "text": texts})
    parts = list(chunking._few([batch, batch.slice(0, 0)], 1000))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 2
    assert all(sum(len(x or "") for x in p.column("text").to_pylist()[:-1]) <= 1000 for p in parts)


def test_cover_density_does_not_depend_on_the_order_of_covers(spark):
    """The same covers the other way round have the same sum, so the smaller id comes first."""
    gaps = [5, 1, 7, 8, 1]  # added as they come 1.4027777777777777, from the end 1.402777777777778
    text = lambda gs: "alpha " + " ".join("x " * g + ("beta", "alpha")[i % 2] for i, g in enumerate(gs))
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    chunks = spark.createDataFrame([(1, text(gaps)), (2, text(gaps[::-1]))], "child_id int, text string")
    first, second = lexical.cover_density(asked, chunks).orderBy("rank").collect()
    assert (first.child_id, second.child_id) == (1, 2) and first.score == second.score
