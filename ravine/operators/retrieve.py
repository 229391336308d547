"""Hybrid retrieval for a batch of planned queries: channels, fusion, parents, reranking, refusals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.functions import text as tx
from ravine.operators import fusion
from ravine.operators.lexical import top
from ravine.sources.versions import stored


@dataclass
class Limits:
    """How many rows each step keeps, and what is refused."""

    reranked: int = 20
    final: int = 5
    refuse_under: float = 0.6
    alpha: float = 0.6


def planned(queries: DataFrame, graph_query: Column | None = None) -> DataFrame:
    """Q1, Q2, Q5: plans of queries (query_id, text) without a planner's answer, in parse_plans()'s columns.

    A query that hints at relations asks for the graph, with graph_query as its traversal, and
    weighs it fully; others weigh it by half.
    """
    asks = tx.requires_graph(F.col("text"))
    graph = F.when(asks, F.lit("MATCH") if graph_query is None else graph_query)
    weights = F.create_map(F.lit("lexical"), F.lit(0.7), F.lit("semantic"), F.lit(0.8), F.lit("graph"), F.when(asks, 1.0).otherwise(0.5))
    return queries.select(
        "query_id", tx.keywords(F.col("text")).alias("keywords"), F.col("text").alias("semantic_query"), graph.alias("graph_query"),
        asks.alias("requires_graph"), tx.intent(F.col("text")).alias("intent"), weights.alias("weights"),
    )


def retrieve(queries: DataFrame, plans: DataFrame, channels: dict[str, DataFrame], chunks: DataFrame, parents: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(results, status) of queries (query_id, text) over the channels `lexical`, `semantic` and `graph`.

    The graph answers only queries whose plan asks for it. Fusion weighs ranks as each query's plan
    says; the best are expanded to their parents (parents: parent_id, text, and what else is to be
    shown), and reranked on the parent's text. results has query_id, child_id, parent_id, rank,
    score, the channels' ranks and the parents' other columns; status has a row for every query
    with its best score, whether it is refused, and why. A chunk without a parent is judged by its
    own text. chunks has child_id, parent_id, text and any further columns.
    """
    channels = {**channels, "graph": fusion.gated(channels["graph"], plans)}
    fused = fusion.fuse(channels, plans=plans).withColumn("rrf_score", F.round("rrf_score", 9))
    # a table of a few rows for each query, so that only their texts and parents are read, and both results share it
    best = stored(top(fused, "rrf_score", limits.reranked).drop("rank"), "fused")
    judged = lambda df, *keep: df.select(*keep, F.array_distinct(tx.words(F.col("text"))).alias("words"), tx.is_table(F.col("text")).alias("table"))
    own = chunks.join(best.select("child_id").distinct(), "child_id", "left_semi")
    rows = stored(best.join(judged(own, "child_id", "parent_id"), "child_id"), "candidates")
    shown = [c for c in parents.columns if c not in ("parent_id", "text")]
    wanted = parents.join(rows.select("parent_id").distinct(), "parent_id", "left_semi")
    # a parent's words are found once, however many candidates it has
    whole = fusion.expand_parents(rows.withColumnsRenamed({"words": "_words", "table": "_table"}), judged(wanted, "parent_id", *shown))
    asked = whole.join(queries.select("query_id", F.col("text").alias("_question")), "query_id")
    score = fusion.lightweight_score(
        F.col("_question"), None, F.col("rrf_score"), F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("table", "_table", F.lit(False)), F.coalesce("words", "_words", F.array().cast("array<string>"))
    )
    scored = asked.withColumn("score", F.round(score, 6)).drop("_question", "_words", "_table", "words", "table")
    results = fusion.relative(scored, "score", limits.refuse_under, limits.alpha, limits.final)
    status = fusion.refusals(queries, scored, "score", limits.refuse_under)
    return results.select("query_id", "child_id", "parent_id", "rank", "score", *(f"{n}_rank" for n in channels), *shown), status
