"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may join.
LIMIT = 10_000


def split_join(left: DataFrame, right: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """left and right joined on key (inner), a key of more than limit rows of right in parts of about that many.

    Rows of right are dealt to the parts of their key by their hash, so equal rows stay together;
    each row of left meets every part of its key. Only keys over the limit are in the table of
    parts, which so has at most a limit-th of right's rows. No columns but the key may be shared.
    """
    hubs = right.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = right.join(hubs, key, "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts)).drop("_parts")
    met = left.join(hubs, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return met.withColumn("_part", F.col("_part").cast("long")).join(dealt.withColumn("_part", F.col("_part").cast("long")), [key, "_part"]).drop("_part")
