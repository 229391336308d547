"""The engine's tables as the given data stands in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.operators import boundaries, grams
from ravine.operators.index import LexicalIndex
from ravine.operators.vector_index import VectorIndex
from ravine.sources.tables import table
from ravine.sources.versions import Versioned, fingerprint, shared_folder

#: The moment that look-backs count from: the end of the orders.
NOW = "2001-08-01 00:00:00"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks; five of them share a parent."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("child_id"), F.expr("doc_id div 5").alias("parent_id"), F.col("source").alias("source_document"), F.col("lang").alias("collection"), "text")


def lexical_index(spark: SparkSession, d: str) -> LexicalIndex:
    """The stored index of the chunks; built when it is first asked for, and again when the documents' files change (the number is that of the format)."""
    print_ = fingerprint(spark, f"{d}/documents.parquet")
    index = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-3-{print_}")
    index.add(chunks(spark, d), print_, by=["collection"])
    return index


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The stored index of the vectors; built when it is first asked for, and again when their files change."""
    print_ = fingerprint(spark, f"{d}/embeddings.parquet")
    index = VectorIndex(spark, f"{shared_folder(spark)}/vectors-1-{print_}")
    index.add(vectors(spark, d), print_)
    return index


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The chunks' vectors by the feature-hashing embedder, stored under the documents' fingerprint."""
    print_ = fingerprint(spark, f"{d}/documents.parquet")
    held = Versioned(spark, f"{shared_folder(spark)}/hashed-1-{print_}", ("child_id",))
    if not held.committed(print_):
        held.append(boundaries.embedded(chunks(spark, d), boundaries.hashing_embedder(64)).select("child_id", "embedding"), print_)
    return held.read()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("child_id"), "embedding", "label")


def text_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, grams of the names) of the chunks: terms of twelve characters or more that two to ten chunks hold.

    They are tables beside the stored index, and are made anew with it.
    """
    print_ = fingerprint(spark, f"{d}/documents.parquet")
    home = f"{shared_folder(spark)}/graph-3-{print_}"
    entities, mentions, names = (Versioned(spark, f"{home}/{n}", (key,)) for n, key in (("entities", "entity_id"), ("mentions", "entity_id"), ("grams", "gram")))
    if not names.committed(print_):
        blocks = lexical_index(spark, d).blocks().where(F.length("term") >= 12)
        terms = blocks.groupBy("term").agg(F.sum("n").alias("n")).where("n BETWEEN 2 AND 10").select(F.col("term").alias("entity_id"), F.col("term").alias("name"))
        entities.append(terms, print_)
        held = blocks.select(F.col("term").alias("entity_id"), F.explode("ids").alias("child_id"))
        mentions.append(held.join(entities.read().select("entity_id"), "entity_id", "left_semi"), print_)
        names.append(grams.posted(entities.read()), print_)
    return entities.read(), mentions.read(), names.read()


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as a batch of queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stated set of query vectors: those whose id is divisible by 50."""
    return vectors(spark, d).where("child_id % 50 = 0").withColumnRenamed("child_id", "query_id")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as calls: F is completed, O in progress, P missed; urgent and high ones came in."""
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("no_answer")
    return o.select(
        F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_totalprice").alias("duration"), state.alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "inbound").otherwise("outbound").alias("direction"),
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: P is pending."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("customer_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("completed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("due_date"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("agent_id"), F.col("c_mktsegment").alias("segment"))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers."""
    part = lambda t, k, n, p, kind: table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("entity_id"), F.col(n).alias("name"), F.lit(kind).alias("entity_type"))
    return part("region", "r_regionkey", "r_name", "R", "REGION").union(part("nation", "n_nationkey", "n_name", "N", "NATION")).union(part("supplier", "s_suppkey", "s_name", "S", "SUPPLIER"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are in nations, nations in regions."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, d, "supplier").select(node("S", "s_suppkey").alias("src"), node("N", "s_nationkey").alias("dst"), F.lit("BASED_IN").alias("relation_type"))
    n = table(spark, d, "nation").select(node("N", "n_nationkey").alias("src"), node("R", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("relation_type"))
    return s.union(n)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Orders mention the suppliers of their lines."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("entity_id"), F.col("l_orderkey").alias("child_id")).distinct()
