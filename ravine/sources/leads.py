"""Leads from CSV files with any of several heads; what is not known goes into custom_fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Heads of the columns that are known.
ALIASES = {"phone": ["phone", "phone_e164", "Phone"], "name": ["name", "Name"], "email": ["email", "Email"]}


def _first(df: DataFrame, names: list[str]) -> Column:
    there = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(None).cast("string"))


def leads(rows: DataFrame) -> DataFrame:
    """Phone (with a plus sign), name, email, custom_fields (JSON); rows without a phone are skipped."""
    known = {n for names in ALIASES.values() for n in names}
    rest = [c for c in rows.columns if c not in known]
    phone = _first(rows, ALIASES["phone"])
    extra = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda k, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    out = rows.select(
        F.when(F.startswith(phone, F.lit("+")), phone).otherwise(F.concat(F.lit("+"), phone)).alias("phone"),
        _first(rows, ALIASES["name"]).alias("name"), _first(rows, ALIASES["email"]).alias("email"), F.to_json(extra).alias("custom_fields"),
    )
    return out.where("phone is not null")


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Files may have different heads; Spark reads those of one call with the first one's."""
    return leads(spark.read.csv(path, header=True))
