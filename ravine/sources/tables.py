"""Tables in Parquet: scans, and sinks that append, upsert, delete and rewrite without a table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A scan; filters and columns reach the files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def updated(old: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that fit get the values."""
    return old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(old: DataFrame, where: Column) -> DataFrame:
    """Rows that do not fit, or for which that is unknown."""
    return old.where(~F.coalesce(where, F.lit(False)))


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A column of text lines, as metrics are exposed."""
    df.write.mode("overwrite").text(path)
