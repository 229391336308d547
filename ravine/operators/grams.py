"""Containment by q-grams: which names hold which keywords, without comparing all pairs.

Names are posted under their grams of one, two and three characters. A keyword of three
characters or more is looked up under the rarest of its grams of three, a shorter one under
itself; the names found there are verified. A gram that very many names hold is met in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.operators.hot import LIMIT
from ravine.sources.versions import stored

Q = 3


def _grams(text: Column, size: int) -> Column:
    """The different grams of a size; none in a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def posted(names: DataFrame) -> DataFrame:
    """The index of names (name): (gram, name, low) for each different gram of one to three characters of each different name."""
    held = names.where("name <> ''").select("name").distinct().withColumn("low", F.lower("name"))
    return held.select(F.explode(F.concat(*(_grams(F.col("low"), q) for q in range(1, Q + 1)))).alias("gram"), "name", "low")


def containing(keywords: DataFrame, names: DataFrame, limit: int = LIMIT, index: DataFrame | None = None) -> DataFrame:
    """(keyword, name) for every keyword (keyword) that a name (name) holds, whatever the case; each pair once.

    Null and empty keywords are in no name. Wildcards are plain characters. index is posted() of the
    names, where it is stored; only the postings of the keywords' rarest grams are shuffled.
    """
    index = posted(names) if index is None else index
    asked = keywords.where("keyword <> ''").select("keyword").distinct().withColumn("_low", F.lower("keyword"))
    own = asked.select("keyword", "_low", F.explode(F.when(F.length("_low") < Q, F.array("_low")).otherwise(_grams(F.col("_low"), Q))).alias("gram"))
    spread = index.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no name holds rules its keyword out
    rarest = own.join(spread, "gram", "left").groupBy("keyword", "_low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    parts = F.ceil(F.col("r.n") / limit).cast("int").alias("_parts")
    probes = stored(rarest.where("r.n > 0").select("keyword", "_low", F.col("r.gram").alias("gram"), parts), "probes")
    dealt = index.join(probes.select("gram", "_parts").distinct(), "gram").withColumn("_part", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int"))
    met = probes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").join(dealt.drop("_parts"), ["gram", "_part"])
    return met.where(F.contains("low", F.col("_low"))).select("keyword", "name")
