"""Every corpus operator and pipeline stage on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from ravine.llm import decontaminate, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, simhash, substring_dedup, suffix_array, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (2, "le renard brun saute par dessus le chien " * 12, "fr", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, "a text without an id\nand two lines\nand three", "en", "b", 1),
    (5, "12345 !!", "en", "a", 1),
    (6, LONG, "en", "a", 1),
    (7, "x" * 5000, None, "c", 5000),
    (8, "\n\n\n", "en", "c", 3),
    (9, "the quick brown fox jumps over the lazy dog " * 12, None, "c", 1),
]
CLASH = ["_id", "_text", "_hash", "_row", "_key", "_spans", "_gone", "fingerprint", "size", "score", "lang_pred", "n_lines", "kept", "_kept_id"]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.selectExpr("*", f"'own' as `{c}`")
    return df


OPERATORS = {
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "language": lambda s, d: language_id.predict(d.drop("score"), language_id.fit(d, sample_docs=50, rounds=1)),
    "accepted": lambda s, d: language_id.accepted(d, language_id.fit(d, sample_docs=50, rounds=1)),
    "mix": lambda s, d: mixing.mix(d),
    "lm": lambda s, d: lm_scoring.score(d, lm_scoring.train(d)),
    "tokens": lambda s, d: token_counts.count_tokens(d),
    "paragraphs": lambda s, d: substring_dedup.remove_paragraphs(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "suffix": lambda s, d: suffix_array.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_row(spark, name):
    got = OPERATORS[name](spark, docs(spark)).collect()
    # the four texts without a letter have no language
    assert len(got) == (len(ROWS) - 4 if name == "accepted" else len(ROWS))
    if "_row" in (got[0].asDict()):
        assert {r["_row"] for r in got} == {"own"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "le renard brun saute par dessus le chien le renard"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (ROWS, []):
        d = spark.createDataFrame(rows, SCHEMA)
        out = stage(spark, d, folder)
        got = out.collect()
        assert len(got) <= len(rows)
        if name != "mixing":
            assert out.columns == d.columns
    if name == "benchmark decontamination":
        assert {r.doc_id for r in stage(spark, spark.createDataFrame(ROWS, SCHEMA), folder).collect()} == {1, 3, 4, None, 5, 6, 7, 8, 9}


def test_near_duplicates_keep_one(spark):
    kept = simhash.drop_near_duplicates(docs(spark)).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and not any(r.doc_id == 9 for r in kept)
    assert all(r["_kept_id"] == "own" for r in kept)


def test_passages(spark):
    bench = spark.createDataFrame([(1, "brown fox jumps over the lazy dog the quick brown fox"), (2, None), (3, ""), (4, "ab")], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark), bench).collect()
    assert {r.doc_id for r in got} == {1, 9}
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark), bench.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (11, [], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as key", "2 as dim", "3 as n")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect()]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), *alone]))
    assert embedding_dedup.embedding_components(df.where("false")).count() == 0
