"""Rows of one tenant only: a filter at the scan, so Parquet partitioned by tenant is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant, column: str = "org_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(tenant))


def scoped_mentions(mentions: DataFrame, entities: DataFrame, tenant, column: str = "org_id") -> DataFrame:
    """Mentions have no tenant of their own: theirs is their entity's."""
    return mentions.join(scoped(entities, tenant, column).select("entity_id"), "entity_id", "left_semi")
