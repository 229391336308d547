"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text is cut at newlines into lines. A rolling hash over the last WINDOW line hashes decides
after which lines a chunk ends, so the boundaries depend on nearby content alone: text that is
inserted or removed elsewhere does not shift them. A chunk of at least `min_lines` lines whose
bytes occur more than once in the whole table is kept where it occurs first, by smallest
(doc_id, hash of the text, position), and removed everywhere else. Chunks are found by a
64-bit hash, and removed only after the bytes themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravine.llm.common import packed, stored, unpacked

#: The polynomial rolling hash of three line hashes, each the first 28 bits of the line's MD5.
_PRIME = 2147483647
_WEIGHTS = (1, 131071, 1048583)
#: A line ends a chunk if the rolling hash leaves 0: one line in DIVISOR does.
DIVISOR = 4


def _chunks(docs: DataFrame) -> DataFrame:
    """docs with _chunks: array of (j, lines, text) that make up _text again when joined by newlines."""
    lines = docs.withColumn("_lines", F.split("_text", "\n", -1))
    hashed = lines.withColumn(
        "_hashes", F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    )

    def rolled(i: Column) -> Column:
        terms = [F.coalesce(F.get("_hashes", i - k), F.lit(0).cast("long")) * F.lit(w) for k, w in enumerate(_WEIGHTS)]
        return (terms[0] + terms[1] + terms[2]) % F.lit(_PRIME)

    count = F.size("_lines")
    starts = hashed.withColumn(
        "_starts",
        F.filter(F.sequence(F.lit(0), count - 1), lambda i: (i == 0) | (rolled(i - 1) % F.lit(DIVISOR) == 0)),
    )

    def chunk(start: Column, j: Column) -> Column:
        many = F.coalesce(F.get("_starts", j + 1), count) - start
        return F.struct(j.alias("j"), many.alias("lines"), F.array_join(F.slice("_lines", start + 1, many), "\n").alias("text"))

    return starts.withColumn("_chunks", F.transform("_starts", chunk)).drop("_lines", "_hashes", "_starts")


def removable(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(_id, _hash, _gone): for documents that lose chunks, the numbers of the chunks to remove.

    docs has _id, _text and _hash, the 64-bit hash of the text; rows that agree in _id and text
    count as one document.
    """
    own = docs.where("_text is not null").select("_id", "_hash", "_text")
    pieces = (
        _chunks(own)
        .select("_id", "_hash", F.explode(F.filter("_chunks", lambda c: c["lines"] >= min_lines)).alias("c"))
        .select("_id", "_hash", F.col("c.j").alias("j"), F.col("c.text").alias("piece"), F.xxhash64("c.text").alias("key"))
    )
    several = stored(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    found = stored(pieces.join(several, "key", "left_semi"), "pieces")
    place = F.struct("_id", "_hash", "j")
    first = stored(found.groupBy("key", "piece").agg(F.min(place).alias("first")), "first")
    gone = found.join(first, ["key", "piece"]).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("_id", "_hash").agg(F.collect_set("j").alias("_gone"))


def dedup_lines(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """docs with `text` rid of repeated chunks, and n_lines, n_chunks, removed_chunks, removed_lines.

    docs needs doc_id and text; other columns are kept (those four names are replaced). A null
    text stays null with counts 0; an empty text is one empty line. Repeated rows count as one
    document and get the same result. A text all of whose chunks are removed becomes empty.
    """
    added = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    row = packed(docs, *added)
    keyed = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    lost = removable(keyed, min_lines).withColumnsRenamed({"_id": "_lost_id", "_hash": "_lost_hash"})
    both = keyed.join(lost, keyed._id.eqNullSafe(lost._lost_id) & (keyed._hash == lost._lost_hash), "left")
    out = _chunks(both).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    # places in a set, not looked up chunk by chunk, so that a text of very many chunks takes linear time
    places = F.when(F.size("_chunks") > 0, F.sequence(F.lit(0), F.size("_chunks") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(places, "_gone"), lambda j: F.get("_chunks", j))
    lost_lines = F.aggregate("_gone", F.lit(0), lambda n, j: n + F.get("_chunks", j)["lines"])
    whole = F.aggregate("_chunks", F.lit(0), lambda n, c: n + c["lines"])
    texts = F.array_join(F.transform(kept, lambda c: c["text"]), "\n")
    count = lambda c: F.when(F.col("_text").isNull(), F.lit(0)).otherwise(c).cast("long")
    new = {
        "n_lines": count(whole),
        "n_chunks": count(F.size("_chunks")),
        "removed_chunks": count(F.size("_gone")),
        "removed_lines": count(lost_lines),
    }
    text = F.when(F.size("_gone") > 0, texts).otherwise(F.col("_text"))
    told = out.select("_row", F.struct(text.alias("text"), *(c.alias(n) for n, c in new.items())).alias("_new"))
    named = told.select(*unpacked(told, "_row", "text"), "_new.*")
    return named.select(*(f"`{c}`" for c in [*(c for c in docs.columns if c not in added), *added]))


#: The same in DuckDB, with the digest of the kept text.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT *, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS hs FROM d),
s AS (SELECT *, list_filter(range(0, len(ls)), lambda i: i = 0 OR (
        (coalesce(hs[i], 0) + 131071 * CASE WHEN i >= 2 THEN hs[i - 1] ELSE 0 END
         + 1048583 * CASE WHEN i >= 3 THEN hs[i - 2] ELSE 0 END) % 2147483647) % 4 = 0) AS st FROM h),
c AS (SELECT doc_id, j, coalesce(st[j + 2], len(ls)) - st[j + 1] AS n,
        array_to_string(ls[st[j + 1] + 1 : coalesce(st[j + 2], len(ls))], chr(10)) AS piece
      FROM (SELECT *, unnest(range(0, len(st))) AS j FROM s WHERE text IS NOT NULL)),
f AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, piece ORDER BY doc_id, j) > 1 AS gone FROM c),
g AS (SELECT doc_id, count(*) AS n_chunks, sum(n) AS n_lines, count(*) FILTER (gone) AS removed_chunks,
        coalesce(sum(n) FILTER (gone), 0) AS removed_lines,
        coalesce(string_agg(piece, chr(10) ORDER BY j) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks,
  coalesce(removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(removed_lines, 0)::BIGINT AS removed_lines,
  md5(kept) AS kept_md5
FROM d LEFT JOIN g USING (doc_id)
"""
