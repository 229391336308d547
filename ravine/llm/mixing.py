"""A mix of sources to target weights, cut at each source's exact budget.

Every document gets a hash-random key. A source's documents are ordered by that key; the keys'
leading hexadecimal digits cut each source into ranges, whose token sums are added up into
offsets, and prefix sums inside a range complete the distributed prefix sum: no task holds more
than one range of a source, however large the source. A source whose target is above its size
is repeated whole, and the rest of the target is cut from the ordered documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.llm.common import stored, word_count

#: Leading hexadecimal digits of the key that name a range: 16 ** DIGITS ranges a source.
DIGITS = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (one row each: source, source_size) with `target`.

    Weights repeat over the sources in code point order, null last. share times all sizes are
    shared by weight; a target stops at `most` times its source's size, and what is above is
    shared again by weight until none is above. That is one level L with target =
    min(most * size, L * weight): sources in order of most * size / weight reach their limit
    while it is at most the level that the others would have.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    limit = sources.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * most)
    filled = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = limit.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("_budget"),
        F.sum("_limit").over(filled).alias("_full"),
        (F.sum("_w").over(everything) - F.sum("_w").over(filled)).alias("_open"),
        (F.col("_limit") / F.col("_w")).alias("_ratio"),
    )
    # the level if exactly the sources up to this one are full; the first such level under the next ratio holds
    nxt = F.lead("_ratio").over(Window.orderBy("_ratio", F.col("source").asc_nulls_last()))
    levels = sums.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.when(F.col("_open") > 0, F.col("_open")))
    fits = F.when((F.col("_level") >= F.col("_ratio")) & (F.col("_level") < F.coalesce(nxt, F.lit(float("inf")))), F.col("_level"))
    plain = F.first(F.col("_budget")).over(everything) / F.sum("_w").over(everything)
    picked = levels.withColumn("_fits", fits).withColumn("_first", F.min("_ratio").over(everything)).withColumn("_plain", plain)
    level = F.when(F.col("_plain") < F.col("_first"), F.col("_plain")).otherwise(
        F.coalesce(F.max("_fits").over(everything), F.lit(float("inf")))
    )
    return picked.withColumn("_l", level).select(
        "source", "source_size", F.least(F.col("_limit").cast("double"), F.col("_l") * F.col("_w")).alias("target")
    )


def mix(
    docs: DataFrame,
    key: Column | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source).

    size is the number of words of the whole text (null: 0). taken counts the words that the
    mix takes of a document, repeats counted: size for every whole pass over the source, and
    what the last, partial pass takes in key order; the document at the cut is taken in part,
    so a source's taken words sum up to its target rounded down. key, a hexadecimal string
    column, defaults to the MD5 of doc_id; ties go by size, and rows that agree in both are
    interchangeable. Reruns agree. An empty table gives an empty table; other columns are not read.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if key is None else key
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key")), "sizes")
    ranges = sized.groupBy("source", F.substring("_key", 1, DIGITS).alias("_range")).agg(F.sum("size").alias("_sum"))
    ranges = stored(ranges, "ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_offset"))
    offsets = offsets.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), "_offset", "source_size", "target")
    placed = sized.withColumn("_range", F.substring("_key", 1, DIGITS)).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r"))
    )
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))
    whole = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long"))
    cut = whole - passes * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), cut - start))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken")
    )


#: The same in DuckDB; the level is found by trying every number of full sources.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
b AS (SELECT sum(source_size)::BIGINT * 1.5::DOUBLE AS budget, sum(w)::BIGINT AS all_w FROM s),
r AS (SELECT *, (2 * source_size)::DOUBLE / w AS ratio,
        sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS f,
        sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS fw FROM s),
c AS (SELECT r.*, lead(ratio) OVER (ORDER BY ratio, source NULLS LAST) AS nxt,
        CASE WHEN all_w - fw > 0 THEN (budget - f) / (all_w - fw)::DOUBLE END AS level FROM r, b),
l AS (SELECT CASE WHEN any_value(budget) / any_value(all_w) < min(ratio) THEN any_value(budget) / any_value(all_w)
        ELSE coalesce(max(level) FILTER (level >= ratio AND level < coalesce(nxt, 'infinity'::DOUBLE)), 'infinity'::DOUBLE) END AS lv FROM c, b),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, lv * w) AS target FROM s, l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END * size
   + greatest(0, least(size, CASE WHEN source_size > 0 THEN whole % source_size ELSE 0 END - start)))::BIGINT AS taken
FROM p
"""
