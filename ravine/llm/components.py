"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a
grouped minimum, which Spark combines before the shuffle, and an equi-join, whose hot keys
adaptive execution splits, since both of its sides are tables; no node's links are ever
gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravine.llm.common import discard, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours linked to the smallest of its neighbours and itself; and the table to discard."""
    both = links.union(links.select("lo", "hi")).toDF("u", "v")
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours linked to the smallest of these; and the table to discard."""
    least = stored(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    rest = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return rest.union(least.select("hi", F.col("m").alias("lo"))).distinct(), least


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the smallest node reachable.

    links holds two columns of one orderable type (longs or strings) in any order, with repeats;
    nulls and links of a node to itself are passed over. No links give an empty table.
    """
    now = stored(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "links",
    )
    before, state = None, _state(now)
    while state[0] and state != before:
        large, first = _large_star(now)
        large = stored(large, "links")
        small, second = _small_star(large)
        step = stored(small, "links")
        discard(now, first, second, large)
        now, before, state = step, state, _state(step)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select("lo", "lo").distinct()
    )
