"""The trie of conversations by their turns, rolled up by centroid decomposition.

Every different beginning of a conversation is a node below the beginning that is one turn
shorter. Nodes are found by grouping running hashes of the turns, so a beginning that very many
conversations share is one group that Spark combines before the shuffle.

Totals of subtrees are not summed turn by turn, which would take as many rounds as the longest
conversation has turns. The parent edges are split at centroids instead: a component's centroid
is its deepest node that has more than half of the component's weight at or below it, so its
path up to the component's top is exactly the nodes with that much weight. The total of what
lies at or below the centroid is added along that path and is final for the centroid; then the
centroid goes, and what was below each of its children and what was above are components of at
most half the weight. All components of a round are handled by the same joins and grouped sums,
and rounds are as many as the logarithm of the number of turns, whatever the trie's shape.

A node has a name without further work: its smallest member and its depth. Whether a node is
below a centroid is one lookup: the beginning, of the centroid's depth and one turn, of its
smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravine.llm.common import crc32_sql, discard, stored

#: Conversation ids that are joined to one string before a node's are hashed.
IDS_IN_PIECE = 4096

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, block, h1, h2, chars) of all rows of conversations (conv_id, turn, role, text) with a conv_id.

    pos counts from 1 in the order of turn, null first; equal turns are ordered by content, so
    reruns agree. Rows are dealt by ranges of conversation and turn, so the rows of a giant
    conversation lie in several blocks; places within a block and the blocks' offsets are added up.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.char_length(text).cast("long").alias("chars")
    )
    placed = stored(rows.repartitionByRange("conv_id", "turn", "h1", "h2").withColumn("block", F.spark_partition_id()), "turns")
    own = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = placed.withColumn("_r", F.row_number().over(own)).join(blocks.drop("n"), ["conv_id", "block"])
    out = stored(out.select("conv_id", (F.col("before") + F.col("_r")).alias("pos"), "block", "h1", "h2", "chars"), "numbered")
    discard(placed)
    return out


def rebuilt(turns: DataFrame, convs: DataFrame, most: int = 6, family: int = 100) -> DataFrame:
    """turns as numbered() gives them, with shared beginnings: the first h of a conversation come from its family's first.

    h is the unsigned CRC-32 of the decimal conv_id modulo `most`, the family's first is
    conv_id - conv_id % family. Where that has fewer turns all of them are taken, where it is
    absent none; the conversation's own turns after its first h follow without a gap.
    """
    c = F.col("conv_id")
    head, lead = (F.crc32(c.cast("string")) % most), (c - c % family)
    firsts = turns.where((F.col("pos") < most) & (lead == c))
    sizes = firsts.groupBy(c.alias("lead")).agg(F.max("pos").alias("has"))
    ids = convs.select("conv_id", head.alias("h"), lead.alias("lead")).join(sizes, "lead", "left").withColumn("has", F.least("h", F.coalesce("has", F.lit(0))))
    shared = firsts.select(c.alias("lead"), "pos", F.lit(-1).alias("block"), "h1", "h2", "chars")
    taken = ids.join(shared, "lead").where("pos <= h").select("conv_id", "pos", "block", "h1", "h2", "chars")
    after = turns.where(F.col("pos") > head).join(ids.select("conv_id", "h", "has"), "conv_id")
    return taken.union(after.select("conv_id", (F.col("pos") - F.col("h") + F.col("has")).alias("pos"), "block", "h1", "h2", "chars"))


def _beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, chars, n): the hash of every beginning, of the one before, and the conversation's length.

    A beginning's hash is the exclusive or of its turns' hashes, each salted with its place: 128
    bits, whose agreement is taken for equality.
    """
    salted = stored(turns.select("conv_id", "pos", "block", "chars", F.xxhash64(F.lit(11), "pos", "h1", "h2").alias("s1"), F.xxhash64(F.lit(12), "pos", "h1", "h2").alias("s2")), "salted")
    blocks = salted.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.max("pos").alias("last"))
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sofar = lambda x: F.coalesce(F.bit_xor(x).over(before), zero).alias(f"o{x[1]}")
    blocks = blocks.select("conv_id", "block", sofar("x1"), sofar("x2"), F.max("last").over(conv).alias("n"))
    own = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = salted.withColumns({"w1": F.bit_xor("s1").over(own), "w2": F.bit_xor("s2").over(own)}).join(blocks, ["conv_id", "block"])
    p1, p2 = F.col("w1").bitwiseXOR(F.col("o1")), F.col("w2").bitwiseXOR(F.col("o2"))
    out = within.select(
        "conv_id", F.col("pos").alias("depth"), p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("s1")).alias("q1"), p2.bitwiseXOR(F.col("s2")).alias("q2"), "chars", "n"
    )
    out = stored(out, "beginnings")
    discard(salted)
    return out


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, p1, p2, q1, q2, conv_id, n_convs, chars, weight) of every node; weight counts the turns of members at or below it, itself included."""
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    lower = rows.groupBy("depth", "p1", "p2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(rows.agg(F.count("*").alias("_rows")))
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), null.alias("q1"), null.alias("q2"), "conv_id", "n_convs", zero.alias("chars"), (F.col("_rows") + F.col("n_convs")).alias("weight"))
    return lower.select(*root.columns).union(root)


def subtree_sums(nodes: DataFrame, paths: DataFrame, *values: str) -> DataFrame:
    """(conv_id, depth, values): each value of nodes (conv_id, depth, weight, values) summed over the node's subtree.

    paths (member, at, owner, parent): the node of each beginning of a conversation, named by its
    smallest member, and that of its parent. weight is the sum of positive numbers over a subtree.
    A component is a key of ordinary joins and grouped sums, whose large keys adaptive execution
    splits; it is named by its top.
    """
    zero = F.lit(0).cast("long")
    top = ["top_conv", "top_depth"]
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"))
    start = nodes.crossJoin(F.broadcast(root)).select("conv_id", "depth", *top, "weight", *values, *(zero.alias(f"_a_{v}") for v in values))
    now, done = stored(start.withColumn("final", F.lit(False)), "components"), []
    while not now.where("not final").isEmpty():
        open_ = now.where("not final").drop("final")
        totals = open_.groupBy(*top).agg(F.max("weight").alias("all_weight"))
        heavy = open_.join(totals, top).where("2 * weight > all_weight")
        centre = heavy.groupBy(*top).agg(F.max("all_weight").alias("all_weight"), F.min(F.struct("weight", "conv_id", "depth")).alias("c"))
        met = open_.join(centre, top).join(paths, (F.col("conv_id") == F.col("member")) & (F.col("c.depth") + 1 == F.col("at")), "left")
        below = (F.col("depth") > F.col("c.depth")) & F.coalesce(F.col("parent") == F.col("c.conv_id"), F.lit(False))
        centroid = (F.col("depth") == F.col("c.depth")) & (F.col("conv_id") == F.col("c.conv_id"))
        split = stored(met.select(*open_.columns, "all_weight", F.col("c.weight").alias("c_weight"), below.alias("below"), centroid.alias("centroid"), "owner", "at"), "split")
        sums = split.where("below or centroid").groupBy(*top).agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
        path = (2 * F.col("weight") > F.col("all_weight")) & ~F.col("below")
        new = split.join(sums, top).select(
            "conv_id", "depth",
            F.when(F.col("below"), F.col("owner")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(F.col("below"), F.col("at")).otherwise(F.col("top_depth")).alias("top_depth"),
            F.when(path & ~F.col("centroid"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"),
            *values, *(F.when(path, F.col(f"_a_{v}") + F.col(f"_s_{v}")).otherwise(F.col(f"_a_{v}")).alias(f"_a_{v}") for v in values),
            F.col("centroid").alias("final"),
        )
        after = stored(new, "components")
        discard(split)
        done.append(now)
        now = after
    out = now
    for table in done:
        out = out.union(table)
    out = stored(out.where("final").select("conv_id", "depth", *(F.col(f"_a_{v}").alias(v) for v in values)), "subtree-sums")
    discard(now, *done)
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, given in pieces sorted by node and piece; memory is that of a batch."""
    now, digest = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (conv, depth) == now:
                digest.update(b",")
            else:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (conv, depth), hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, digest.hexdigest())))], schema=schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations convs (conv_id, each once) with the given turns.

    turns is what numbered() or rebuilt() return: (conv_id, pos, block, h1, h2, chars), pos from 1
    without gaps. Conversations without turns are members of the root and end there. Columns,
    long unless said: conv_id, the smallest member; depth; parent_conv_id, the parent's conv_id
    (root: null); n_convs, the members; n_children; n_leaves, the childless nodes of the subtree;
    saved_tokens, over the subtree the sum of (n_convs - 1) times the code points of the node's
    last text; ends_sha256 string, the SHA-256 of the decimal ids, ascending and joined by
    commas, of the members that end at the node. No conversations give no node.
    """
    zero = F.lit(0).cast("long")
    rows = _beginnings(turns)
    nodes = stored(_nodes(rows, convs), "nodes")
    up = (F.col("depth") - 1).alias("depth")
    names = nodes.select("depth", F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy(up, F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    parents = nodes.where("depth > 0").withColumn("_up", F.col("depth") - 1).join(names.withColumnRenamed("depth", "_up"), ["_up", "q1", "q2"]).drop("_up")
    linked = parents.select(*nodes.columns, "parent_conv_id").union(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    linked = linked.join(children, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    tree = stored(linked.withColumns({"n_leaves": leaf, "saved_tokens": saved}), "tree")
    owners = tree.where("depth > 0").select("depth", "p1", "p2", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("parent"))
    paths = rows.join(owners, ["depth", "p1", "p2"]).select(F.col("conv_id").alias("member"), F.col("depth").alias("at"), "owner", "parent", "n")
    paths = stored(paths, "paths")
    discard(rows, nodes)
    sums = subtree_sums(tree.select("conv_id", "depth", "weight", "n_leaves", "saved_tokens"), paths.drop("n"), "n_leaves", "saved_tokens")
    ended = paths.where("at = n").select("member", F.col("owner").alias("conv_id"), F.col("at").alias("depth"))
    root = tree.where("depth = 0").select("conv_id", "depth")
    turnless = convs.select(F.col("conv_id").alias("member")).join(ended.select("member"), "member", "left_anti").crossJoin(F.broadcast(root))
    piece = F.expr(f"member div {IDS_IN_PIECE}").alias("piece")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("member")), lambda i: i.cast("string")), ",")
    pieces = ended.select("conv_id", "depth", "member").union(turnless.select("conv_id", "depth", "member")).groupBy("conv_id", "depth", piece).agg(ids.alias("ids"))
    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    ends = dealt.select("conv_id", "depth", "ids").mapInArrow(_ends, "conv_id long, depth long, ends_sha256 string")
    out = tree.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    out = stored(
        out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")), "trie"
    )
    discard(tree, paths, sums)
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of conversations (conv_id, turn, role, text) as they are, without rebuilding.

    Null roles and texts are empty; rows without a conv_id belong to no conversation and count
    nowhere; rows that agree in everything are turns of their own; other columns are not read.
    """
    convs = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return prefix_trie(numbered(conversations), convs)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of conversations after rebuilt(); nulls and repeats as in conversation_trie()."""
    turns = numbered(conversations)
    convs = stored(turns.select("conv_id").distinct(), "conversations")
    out = prefix_trie(rebuilt(turns, convs), convs)
    discard(turns, convs)
    return out


#: The same in DuckDB: beginnings as texts, and subtrees by the beginnings of each node's smallest member.
ORACLE_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32_sql('conv_id::VARCHAR')} % 6 AS h, conv_id - conv_id % 100 AS lead FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.lead AND o.pos <= i.h
    UNION ALL SELECT i.conv_id, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.conv_id AND o.pos > i.h),
d AS (SELECT conv_id, text, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
a AS (SELECT conv_id, depth, md5(k) AS k, md5(left(k, (64 * (depth - 1))::BIGINT)) AS up, n, length(text) AS chars FROM d
    UNION ALL SELECT conv_id, 0, md5(''), NULL, coalesce((SELECT count(*) FROM r WHERE r.conv_id = ids.conv_id), 0), 0 FROM ids),
v AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM a GROUP BY depth, k),
c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT v.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent_conv_id
    FROM v LEFT JOIN c ON c.depth = v.depth AND c.k = v.k LEFT JOIN v p ON p.depth = v.depth - 1 AND p.k = v.up),
s AS (SELECT a.depth, a.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
    FROM x JOIN a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1, 2)
SELECT x.conv_id, x.depth::BIGINT AS depth, x.parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.k = x.k
"""
