"""Fusion of ranked channels, and what follows it: filters, normalisation, reranking, parents, formatting.

A channel is (query_id, child_id, rank, score). Channels are fused by union and one grouped sum,
so any number of them costs one shuffle; what follows is by windows over a query's candidates,
whose number the channels' limits bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.functions import text as tx
from ravine.operators.lexical import top

_KEY = ["query_id", "child_id"]


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = fixed.RRF_K, plans: DataFrame | None = None) -> DataFrame:
    """weighted reciprocal ranks. A channel without a row of a chunk adds nothing.

    One row for each query and chunk: rrf_score, and by channel its rank and score (null where
    it has none), and sources, the channels in name order. plans (query_id, weights map) weigh each
    query's channels on their own; what a plan leaves out weighs as in `weights`, or 1.
    """
    weights = weights or {}
    union = None
    for name, c in channels.items():
        part = c.select(*_KEY, F.lit(name).alias("channel"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
        union = part if union is None else union.unionByName(part)
    own = [F.max(F.when(F.col("channel") == n, F.col(c))).alias(f"{n}_{c}") for n in channels for c in ("rank", "score")]
    out = union.groupBy(*_KEY).agg(*own, F.sort_array(F.collect_set("channel")).alias("sources"))
    default = {n: F.lit(float(weights.get(n, 1.0))) for n in channels}
    weight = default
    if plans is not None:
        out = out.join(plans.select("query_id", F.col("weights").alias("_weights")), "query_id", "left")
        weight = {n: F.coalesce(F.try_element_at("_weights", F.lit(n)), default[n]) for n in channels}
    parts = [F.coalesce(weight[n] / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n in channels]
    return out.withColumn("rrf_score", sum(parts[1:], parts[0])).drop("_weights")


def fuse_outer(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float, k: int = fixed.RRF_K) -> DataFrame:
    """Two channels by a full outer join."""
    left = a.select(*_KEY, F.col("rank").alias("rank_a"))
    right = b.select(*_KEY, F.col("rank").alias("rank_b"))
    part = lambda w, c: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    return left.join(right, _KEY, "full").withColumn("rrf_score", part(weight_a, "rank_a") + part(weight_b, "rank_b"))


def safe(rows: DataFrame, least: float, *scores: str) -> DataFrame:
    """Rows whose best channel score reaches `least`; no filter if that is not above 0."""
    return rows if least <= 0 else rows.where(F.coalesce(F.greatest(*scores), F.lit(0.0)) >= least)


def conformal(rows: DataFrame, score: str = "rrf_score", alpha: float = 0.6, least_rows: int = 3) -> DataFrame:
    """By query, rows at or above the (1 - alpha) percentile; queries of fewer rows keep all."""
    own = Window.partitionBy("query_id")
    cut = rows.withColumns({"_cut": F.percentile(score, F.lit(1 - alpha)).over(own), "_n": F.count("*").over(own)})
    return cut.where((F.col("_n") < least_rows) | (F.col(score) >= F.col("_cut"))).drop("_cut", "_n")


def relative(rows: DataFrame, score: str = "score", refuse_under: float = 0.6, alpha: float = 0.6, k: int = 5) -> DataFrame:
    """Queries whose best score is under refuse_under keep nothing; others keep rows of alpha times the best, k at most."""
    best = rows.withColumn("max_score", F.max(score).over(Window.partitionBy("query_id"))).where(F.col("max_score") >= refuse_under)
    return top(best.where(F.col(score) >= alpha * F.col("max_score")), score, k)


def refusals(queries: DataFrame, rows: DataFrame, score: str = "score", refuse_under: float = 0.6) -> DataFrame:
    """Every query with its best score, whether it is refused, and why."""
    best = queries.select("query_id").join(rows.groupBy("query_id").agg(F.max(score).alias("max_score")), "query_id", "left")
    reason = F.when(F.col("max_score").isNull(), "no candidates").when(F.col("max_score") < refuse_under, "best score under threshold")
    return best.withColumn("reason", reason).withColumn("refused", F.col("reason").isNotNull())


def min_max(rows: DataFrame, score: str, by: str = "query_id") -> DataFrame:
    """`normalized` from 0 to 1 by query; 1 if all scores are equal."""
    own = Window.partitionBy(by)
    ends = rows.withColumns({"_low": F.min(score).over(own), "_high": F.max(score).over(own)})
    value = F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
    return ends.withColumn("normalized", value).drop("_low", "_high")


def lightweight_score(question: Column, content: Column | None, rrf: Column, similarity: Column, table: Column, words: Column | None = None) -> Column:
    """F8: half the fused score, 0.3 of the similarity, 0.2 of the share of question words in the content.

    A table counts 1.2 times for a question with a data word. words: the content's different
    words, where they are at hand.
    """
    asked, held = F.array_distinct(tx.words(question)), F.array_distinct(tx.words(content)) if words is None else words
    overlap = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    score = rrf * 0.5 + similarity * 0.3 + overlap * 0.2
    data = F.arrays_overlap(asked, F.array(*map(F.lit, fixed.DATA_WORDS)))
    return F.when(table & data, score * 1.2).otherwise(score)


def expand_parents(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Every candidate with its parent's columns; candidates without a parent stay."""
    return rows.join(parents, "parent_id", "left")


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Each parent of a child once."""
    return parents.join(children.select("parent_id"), "parent_id", "left_semi")


def context(rows: DataFrame, text: str = "text") -> DataFrame:
    """by query, the texts in rank order between rules."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text])
    return rows.groupBy("query_id").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


def formatted(score: Column) -> Column:
    """four places, and nothing for 0."""
    return F.nullif(F.round(score, 4), F.lit(0.0))


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def filtered(rows: DataFrame, least: float = 0.0, **equal) -> DataFrame:
    """Rows of a similarity of least or a lexical hit, whose columns agree with those values that are given."""
    if least > 0:
        rows = rows.where((F.coalesce("semantic_score", F.lit(0.0)) >= least) | (F.coalesce("lexical_score", F.lit(0.0)) > 0))
    for column, value in equal.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def scoped(chunks: DataFrame, documents: DataFrame, key: str, **equal) -> DataFrame:
    """Chunks of the documents whose columns agree with those values that are given; all chunks if none is."""
    given = {c: v for c, v in equal.items() if v is not None}
    return chunks.join(filtered(documents, **given).select(key), key, "left_semi") if given else chunks


def gated(graph: DataFrame, plans: DataFrame, enabled: bool = True) -> DataFrame:
    """The graph channel's rows of queries whose plan (query_id, requires_graph, graph_query) asks for it."""
    asked = plans.where(F.lit(enabled) & F.col("requires_graph") & (F.coalesce(F.trim("graph_query"), F.lit("")) != ""))
    return graph.join(asked.select("query_id"), "query_id", "left_semi")
