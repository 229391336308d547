"""Search as table functions of SQL, over a stored lexical index and stored vectors.

After register(), `SELECT * FROM hybrid_search('a question', 10)` answers one question, and
`FROM questions q, LATERAL lexical_search(q.text, 10)` a table of them. The bodies are SQL, so
they become part of the query's own plan: a single question ends in Spark's top-k by partition,
and a table of questions is joined to the index's blocks by term.

    hashed_embedding(text)    unit vector of the feature-hashing embedder, an array of doubles
    lexical_search(query, k)  (child_id, score, rank) by BM25
    semantic_search(query, k) (child_id, score, rank) by cosine to the vectors; reads all of them
    hybrid_search(query, k)   (child_id, score, rank, lexical_rank, semantic_rank), weighted reciprocal ranks

Ties go to the smaller child_id. A null question, or one without a term, has no lexical row; its
vector is zero, which is similar to nothing and gives no semantic row either: a similarity that rounds
to zero is none. k under 1 gives no row. A table of questions is handled text by text, so equal
questions are answered once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.operators.index import LexicalIndex
from ravine.sources.versions import stored

#: Vectors that a question is compared with first, for a bound below which none can be among the best.
SEEDS = 4096
_TERMS = r"filter(split(lower({}), '[^\\p{{L}}\\p{{N}}]+'), t -> t <> '')"
_SEARCH = "TABLE(child_id BIGINT, score DOUBLE, rank INT)"


def _function(spark: SparkSession, head: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register(
    spark: SparkSession, index: LexicalIndex, vectors: DataFrame, dims: int = 64, depth: int = 50, lexical: float = 0.7, semantic: float = 0.8,
    k1: float = 1.2, b: float = 0.75, places: int = 6,
) -> None:
    """Register the functions for this session over a lexical index and vectors (child_id, embedding).

    They stand for the versions that both have now; register again after a commit. The corpus figures
    are put into the functions, and the terms' frequencies into a table beside the index.
    depth: rows of each channel that hybrid_search fuses, with the weights lexical and semantic.
    Null and zero vectors are similar to nothing.
    """
    chunks, length, _ = index.figures()
    mean = length / chunks if chunks else 1.0
    index.blocks().createOrReplaceTempView("search_blocks")
    stored(index.blocks().groupBy("term").agg(F.sum("n").alias("df")), "terms").createOrReplaceTempView("search_terms")
    # components as columns, so that a product is compiled code and no loop over an array
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    laid = vectors.where(F.size("embedding") == dims).select("child_id", F.sqrt(squares).alias("size"), *(F.get("embedding", F.lit(i)).alias(f"v{i}") for i in range(dims)))
    units = stored(laid.where("size > 0"), "vectors")
    units.createOrReplaceTempView("search_vectors")
    # one row with some of the vectors, the same ones each time
    some = units.orderBy(F.xxhash64("child_id"), "child_id").limit(SEEDS).select("size", F.array(*(f"v{i}" for i in range(dims))).alias("v"))
    stored(some.agg(F.collect_list(F.struct("size", "v")).alias("seeds")), "seeds").createOrReplaceTempView("search_seeds")
    digits = "cast(conv(substr(md5(t), {}), 16, 10) AS BIGINT)"
    hashed = f"transform({_TERMS.format('text')}, t -> struct({digits.format('1, 8')} % {dims} AS d, 1 - 2 * ({digits.format('9, 1')} % 2) AS s))"
    # a transform of one element names what its body uses many times
    sums = f"transform(array({hashed}), ts -> transform(sequence(0, {dims - 1}), i -> aggregate(filter(ts, t -> t.d = i), 0D, (a, t) -> a + t.s)))"
    unit = f"transform({sums}, v -> transform(array(sqrt(aggregate(v, 0D, (a, x) -> a + x * x))), n -> transform(v, x -> if(n > 0, x / n, 0D)))[0])[0]"
    _function(spark, "hashed_embedding(text STRING) RETURNS ARRAY<DOUBLE>", unit)
    _function(
        spark,
        f"lexical_search(query STRING, k INT) RETURNS {_SEARCH}",
        f"""
        WITH asked AS (SELECT explode(array_distinct({_TERMS.format("lexical_search.query")})) AS term),
        weights AS (SELECT term, ln(1 + ({chunks} - df + 0.5D) / (df + 0.5D)) AS idf FROM search_terms JOIN asked USING (term)),
        -- a question meets whole blocks, so its text goes through the shuffle once for a range; ranges give their own best
        met AS (SELECT range, collect_list(struct(idf, ids, tfs, lengths)) AS blocks FROM search_blocks JOIN weights USING (term) GROUP BY range),
        opened AS (SELECT range, explode(blocks) AS b FROM met),
        hits AS (SELECT range, b.idf AS idf, explode(arrays_zip(b.ids, b.tfs, b.lengths)) AS p FROM opened),
        scored AS (SELECT range, p.ids AS child_id, round(sum(idf * p.tfs * {k1 + 1}D / (p.tfs + {k1}D * ({1 - b}D + {b}D * p.lengths / {mean!r}D))), {places}) AS score FROM hits GROUP BY range, p.ids),
        near AS (SELECT child_id, score, row_number() OVER (PARTITION BY range ORDER BY score DESC, child_id) AS place FROM scored WHERE score > 0),
        ranked AS (SELECT child_id, score, row_number() OVER (ORDER BY score DESC, child_id) AS rank FROM near WHERE place <= lexical_search.k)
        SELECT child_id, score, rank FROM ranked WHERE rank <= lexical_search.k""",
    )
    parts = [f"v{i} * q{i}" for i in range(dims)]
    dot = " + ".join(f"({' + '.join(parts[i : i + 16])})" for i in range(0, dims, 16))
    similarity = f"round(({dot}) / size, {places})"
    seed = "aggregate(zip_with(s.v, q, (x, y) -> x * y), 0D, (a, x) -> a + x)"
    _function(
        spark,
        f"semantic_search(query STRING, k INT) RETURNS {_SEARCH}",
        f"""
        WITH asked AS (SELECT hashed_embedding(semantic_search.query) AS q),
        -- what is under the k-th best of some vectors, sums' last digits apart, is not among the k best of all
        near AS (SELECT q, sort_array(filter(transform(seeds, s -> round({seed} / s.size, {places})), x -> x <> 0), false) AS best FROM asked, search_seeds),
        bound AS (SELECT {", ".join(f"q[{i}] AS q{i}" for i in range(dims))}, coalesce(get(best, semantic_search.k - 1) - {2 * 10.0**-places!r}D, -2D) AS least FROM near),
        scored AS (SELECT /*+ BROADCAST(bound) */ child_id, {similarity} AS score FROM bound, search_vectors WHERE {similarity} >= least AND {similarity} <> 0),
        ranked AS (SELECT child_id, score, row_number() OVER (ORDER BY score DESC, child_id) AS rank FROM scored)
        SELECT child_id, score, rank FROM ranked WHERE rank <= semantic_search.k""",
    )
    part = f"coalesce({{}}D / ({fixed.RRF_K} + {{}}), 0D)"
    _function(
        spark,
        "hybrid_search(query STRING, k INT) RETURNS TABLE(child_id BIGINT, score DOUBLE, rank INT, lexical_rank INT, semantic_rank INT)",
        f"""
        WITH channels AS (
            SELECT child_id, rank AS lexical_rank, cast(NULL AS INT) AS semantic_rank FROM lexical_search(hybrid_search.query, {depth})
            UNION ALL SELECT child_id, NULL, rank FROM semantic_search(hybrid_search.query, {depth})),
        both AS (SELECT child_id, max(lexical_rank) AS lexical_rank, max(semantic_rank) AS semantic_rank FROM channels GROUP BY child_id),
        fused AS (SELECT *, round({part.format(lexical, "lexical_rank")} + {part.format(semantic, "semantic_rank")}, 9) AS score FROM both),
        ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, child_id) AS rank FROM fused)
        SELECT child_id, score, rank, lexical_rank, semantic_rank FROM ranked WHERE rank <= hybrid_search.k""",
    )
