"""Idempotent ingestion: what is new is found by anti-joins on hashes, what is repeated by one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravine.functions import text as tx
from ravine.operators import chunking


def unregistered(docs: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Documents (org_id, hash) that are not known yet; all of them if forced."""
    return docs if force else docs.join(known.select("org_id", "hash"), ["org_id", "hash"], "left_anti")


def first_of_each(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def new_chunks(chunks: DataFrame, stored: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Chunks that the store does not hold, each content once."""
    return first_of_each(chunks.join(stored.select(*key), key, "left_anti"), key, *order)


EXTRACTION = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "type", "canonical_name", "description")]))),
    T.StructField("relations", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "object", "type")] + [T.StructField("confidence", T.DoubleType())]))),
])


def parse_extraction(rows: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of an extractor's JSON answers (parent_id, json), code fences removed.

    Nameless entities go; a missing type is UNKNOWN, a missing confidence 1.
    """
    body = F.regexp_extract(F.col(json), "(?s)(\\{.*\\})", 1)
    parsed = rows.select("parent_id", F.from_json(body, EXTRACTION).alias("x"))
    entities = parsed.select("parent_id", F.explode("x.entities").alias("e")).where("coalesce(trim(e.name), '') <> ''")
    relations = parsed.select("parent_id", F.explode("x.relations").alias("r"))
    return (
        entities.select("parent_id", F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("e.canonical_name", F.trim("e.name")).alias("canonical_name")),
        relations.select("parent_id", "r.subject", "r.object", F.col("r.type").alias("relation_type"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence")),
    )


def upsert_entities(found: DataFrame, known: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """Known entities and, for keys without one, the first that was found."""
    fresh = first_of_each(found.join(known.select(*key), key, "left_anti"), key, *order)
    return known.unionByName(fresh, allowMissingColumns=True)


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends name entities of the same extraction (name or canonical name)."""
    names = entities.select("parent_id", F.explode(F.array_distinct(F.array("name", "canonical_name"))).alias("_name"), "entity_id").distinct()
    end = lambda c, out: names.select("parent_id", F.col("_name").alias(c), F.col("entity_id").alias(out))
    return relations.join(end("subject", "src"), ["parent_id", "subject"]).join(end("object", "dst"), ["parent_id", "object"])


def mention_rows(entities: DataFrame, children: DataFrame, in_text: bool = False) -> DataFrame:
    """Each entity with the children of its parent; in_text only with those that hold its name."""
    met = entities.join(children.select("parent_id", "child_id", "text"), "parent_id")
    met = met.where(F.contains(F.lower("text"), F.lower("name"))) if in_text else met
    return met.select("entity_id", "parent_id", "child_id").distinct()


def ingest(docs: DataFrame, known: DataFrame, stored: DataFrame, org) -> dict[str, DataFrame]:
    """I4: documents, parents and children to append for docs (document_id, text)."""
    hashed = docs.withColumn("org_id", F.lit(org)).withColumn("hash", F.sha2("text", 256))
    fresh = first_of_each(unregistered(hashed, known), ["org_id", "hash"], "document_id")
    parents, children = chunking.parents_and_children(fresh)
    children = new_chunks(children.withColumn("org_id", F.lit(org)), stored, ["org_id", "content_hash"], "document_id", "child_id")
    return {"documents": fresh.withColumn("status", F.lit("completed")), "parents": parents, "children": children}


def ingest_stats(children: DataFrame) -> DataFrame:
    """Chunks, tokens and tables by document."""
    return children.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(F.col("modality") == "table").alias("tables")
    )


def document_hash(text: Column) -> Column:
    return tx.content_hash(text)


def statuses(docs: DataFrame, known: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """The status of each document (document_id, org_id, hash, error) after a run that made chunks (document_id, ...).

    A loader's error and a document without any chunk are `failed`, with the reason; a hash that
    is known, or that an earlier document of the batch has, is `skipped`; the rest is `completed`.
    """
    made = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    seen = docs.join(known.select("org_id", "hash", F.lit(True).alias("_known")).distinct(), ["org_id", "hash"], "left").join(made, "document_id", "left")
    again = F.row_number().over(Window.partitionBy("org_id", "hash").orderBy(F.col("error").isNotNull(), "document_id")) > 1
    status = F.when(F.col("error").isNotNull(), "failed").when((F.col("_known").isNotNull() & F.lit(not force)) | again, "skipped").when(F.coalesce("chunks", F.lit(0)) == 0, "failed").otherwise("completed")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") == "failed", "no chunks")
    return seen.withColumn("status", status).withColumn("reason", reason).select("document_id", "status", "reason", F.when(F.col("status") == "completed", F.col("chunks")).alias("chunks"))


def ingest_flat(docs: DataFrame, known: DataFrame, stored: DataFrame, org) -> dict[str, DataFrame]:
    """The window chunker's ingestion of docs (document_id, text, error): chunks to append, and every document's status."""
    hashed = docs.withColumn("org_id", F.lit(org)).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    fresh = first_of_each(unregistered(hashed.where("error is null"), known), ["org_id", "hash"], "document_id")
    chunks = chunking.flat_chunks(fresh).withColumn("org_id", F.lit(org))
    return {
        "chunks": new_chunks(chunks, stored, ["org_id", "content_hash"], "document_id", "chunk_index"),
        "documents": statuses(hashed, known, chunks),
    }
