"""Lexical retrieval for batches of queries over chunks, through postings.

Queries (query_id, terms) meet chunks only on equal terms, so nothing is compared that shares
no term, and counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import text as tx
from ravine.sources.versions import stored


def postings(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(child_id, term, tf) of every chunk (child_id, text); only: terms to keep, so that the others are not shuffled."""
    exploded = chunks.select("child_id", F.explode(tx.terms(F.col("text"))).alias("term"))
    exploded = exploded if only is None else exploded.join(only.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy("child_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of every query (query_id, text), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))


def and_matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """L2: (query_id, child_id, tf) of chunks that hold all terms of a query; tf sums up over them."""
    wanted = query_terms(queries)
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hits = wanted.join(postings(chunks, wanted), "term").groupBy("query_id", "child_id").agg(F.count("*").alias("found"), F.sum("tf").alias("tf"))
    return hits.join(sizes, "query_id").where("found = wanted").select("query_id", "child_id", "tf")


def top(scored: DataFrame, score: str, k: int, by: str = "query_id", tie: str = "child_id") -> DataFrame:
    """The k best of each group with their rank; ties by the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tf_search(queries: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    """Chunks with all terms, ranked by term frequency over 1 plus the logarithm of their length."""
    lengths = chunks.select("child_id", F.size(tx.terms(F.col("text"))).alias("length"))
    scored = and_matches(queries, chunks).join(lengths, "child_id")
    return top(scored.withColumn("score", F.col("tf") / (1 + F.ln("length"))), "score", k)


def bm25(queries: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, child_id, score) of every chunk that shares a term with a query.

    Robertson and Zaragoza (2009), with the idf that is never negative.
    """
    lengths = chunks.select("child_id", F.size(tx.terms(F.col("text"))).alias("length")).where("length > 0")
    corpus = lengths.agg(F.count("*").alias("chunks"), F.avg("length").alias("mean"))
    wanted = query_terms(queries)
    hits = postings(chunks, wanted)
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = (
        hits.join(spread, "term").join(lengths, "child_id").join(F.broadcast(corpus))
        .withColumn("idf", F.ln(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .select("child_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))).alias("part"))
    )
    return wanted.join(weighed, "term").groupBy("query_id", "child_id").agg(F.sum("part").alias("score"))


def density(chunks: DataFrame, phrase: str) -> DataFrame:
    """Chunks that hold the phrase, scored by occurrences (not overlapping) for each 100 characters."""
    text, wanted = F.lower("text"), phrase.lower()
    count = (F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)
    return chunks.where(F.contains(text, F.lit(wanted))).withColumn("score", count / F.greatest(F.length(text), F.lit(1)) * 100)


def any_contains(df: DataFrame, phrase: str, *columns: str) -> DataFrame:
    """Rows in which one of the columns holds the phrase, whatever its case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(phrase.lower()))
    return df.where(found)


def cover_density(queries: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    """L3: chunks with all terms, by cover density (Clarke, Cormack and Tudhope 1999).

    A cover is a stretch of the chunk that holds all terms and no shorter such stretch; it counts
    1 / (words in it that are no query terms + 1). One pass over a query's hits in a chunk, in
    order, carries the last place of each term: the earliest of them begins the shortest stretch
    that ends at the hit, and it is a cover if it begins later than the one before. Covers are
    counted by their other words and added shortest first, so that chunks with the same covers have
    the same score to the last bit, wherever these lie, and go by their ids.
    """
    wanted = query_terms(queries)
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    # places are looked up only in chunks that hold all terms: a query's common words alone bring no row
    whole = stored(and_matches(queries, chunks).select("query_id", "child_id"), "whole")
    placed = chunks.join(whole.select("child_id").distinct(), "child_id", "left_semi").select("child_id", F.posexplode(tx.terms(F.col("text"))).alias("at", "term"))
    hits = placed.join(whole.join(wanted, "query_id"), ["child_id", "term"]).groupBy("query_id", "child_id")
    full = hits.agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("hits")).join(sizes, "query_id")
    none = lambda k, v: F.map_from_arrays(F.array().cast(f"array<{k}>"), F.array().cast(f"array<{v}>"))
    state = F.struct(none("string", "int").alias("last"), F.lit(-1).alias("start"), none("bigint", "int").alias("covers"))

    def step(s: Column, h: Column) -> Column:
        last = F.map_concat(F.map_filter(s["last"], lambda t, _: t != h["term"]), F.create_map(h["term"], h["at"]))
        start = F.array_min(F.map_values(last))
        more = (F.size(last) == F.col("wanted")) & (start > s["start"])
        others = F.greatest(h["at"] - start + 1 - F.col("wanted"), F.lit(0).cast("bigint"))
        count = F.coalesce(F.try_element_at(s["covers"], others), F.lit(0)) + 1
        covers = F.map_concat(F.map_filter(s["covers"], lambda n, _: n != others), F.create_map(others, count))
        return F.struct(last.alias("last"), F.when(more, start).otherwise(s["start"]).alias("start"), F.when(more, covers).otherwise(s["covers"]).alias("covers"))

    def score(s: Column) -> Column:
        parts = F.transform(F.array_sort(F.map_entries(s["covers"])), lambda c: F.array_repeat(1 / (c["key"] + 1), c["value"]))
        return F.aggregate(F.flatten(parts), F.lit(0.0), lambda a, x: a + x)

    return top(full.select("query_id", "child_id", F.aggregate("hits", state, step, score).alias("score")), "score", k)


def keyword_queries(queries: DataFrame) -> DataFrame:
    """Queries (query_id, text) with their keywords, joined by blanks, for a text."""
    return queries.select("query_id", F.array_join(tx.keywords(F.col("text")), " ").alias("text"))
