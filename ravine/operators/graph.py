"""The entity graph: entities, relations between them, and their mentions in chunks.

entities (entity_id, name, entity_type), relations (src, dst, relation_type), mentions
(entity_id, child_id). Traversals are joins that keep each node once per step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.operators.grams import containing
from ravine.operators.hot import LIMIT, split_join
from ravine.operators.lexical import top
from ravine.sources.versions import stored

#: Neighbours from which on paths() expands a node once, not for each start.
HUB = 64


def undirected(relations: DataFrame) -> DataFrame:
    return relations.select("src", "dst").union(relations.select("dst", "src")).distinct()


def bipartite(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(node, to): the untyped, undirected edges of the whole graph, relations and mentions; entities are e:id, chunks c:id."""
    entity = lambda c: F.concat(F.lit("e:"), F.col(c).cast("string"))
    both = undirected(relations).select(entity("src").alias("node"), entity("dst").alias("to"))
    mention = mentions.select(entity("entity_id").alias("node"), F.concat(F.lit("c:"), F.col("child_id").cast("string")).alias("to")).distinct()
    return both.union(mention).union(mention.select("to", "node"))


def hubs(edges: DataFrame, most: int) -> DataFrame:
    """(node): the nodes with more than `most` edges (node, to)."""
    return edges.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("node")


def _joined(path: str, sign: str) -> Column:
    """The beginning of a way on from a path, as a string: its nodes, each followed by sign."""
    return F.concat(F.array_join(path, sign), F.lit(sign))


def _apart(level: DataFrame, wide: DataFrame, sign: str | None) -> DataFrame:
    """The rows of level (start, node, path) at the nodes of wide (node) that may be joined by path alone, mid by mid.

    With sign, those that compare with all other rows of their start as strings as they do node by
    node; one that does not (of c:1 and c:12 the strings c:1> and c:12> are in the other order) has to
    meet the others at each node that both reach.
    """
    held = level.join(wide, "node", "left_semi")
    if sign is None:
        return held
    beside = level.join(held.select("start").distinct(), "start", "left_semi").withColumn("_way", _joined("path", sign))
    own, before = Window.partitionBy("start"), (Window.unboundedPreceding, -1)
    most = F.max("path").over(own.orderBy("_way").rowsBetween(*before))
    least = F.min("path").over(own.orderBy(F.desc("_way")).rowsBetween(*before))
    same = beside.withColumns({"_most": most, "_least": least}).where("(_most IS NULL OR _most < path) AND (_least IS NULL OR _least > path)")
    return same.join(wide, "node", "left_semi").select(*level.columns)


def walked(starts: DataFrame, edges: DataFrame, hops: int, limit: int = LIMIT, back: bool = False, shut: Callable[[DataFrame], DataFrame] | None = None, only: DataFrame | None = None, sign: str | None = None) -> DataFrame:
    """(start, node, distance, path) of every node within hops edges of each start (start, a node), itself included.

    path is the least shortest path, as an array from the start on, or back, from the node to the
    start. Every step keeps a node once for
    each start; a hub's edges are met in parts of `limit`. Each frontier is a table, so that no
    step is computed again by the next. The last step leaves out the rows (start, node) of
    shut(frontier) and ends in the nodes of only (to), where they are given. With sign, a step's
    ways to a node are compared as strings, their nodes joined by it.
    """
    first = F.col("start")
    frontier = starts.select("start").distinct().select("start", first.alias("node"), F.lit(0).alias("distance"), F.array(first).alias("path"))
    reached, parts = frontier, (F.col("path"), F.array("node"))
    for hop in range(1, hops + 1):
        ahead, used = frontier.select("start", "node", "path"), edges
        if hop == hops:
            ahead = ahead if shut is None else ahead.join(shut(ahead), ["start", "node"], "left_anti")
            used = used if only is None else used.join(only, "to", "left_semi").select("node", "to")
        step = split_join(ahead, used, "node", limit)
        least = F.min("path") if sign is None else F.min_by("path", _joined("path", sign))
        found = step.groupBy("start", "to").agg(least.alias("path")).withColumnRenamed("to", "node")
        found = found.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        frontier = stored(found.select("start", "node", F.lit(hop).alias("distance"), F.concat(*parts[:: -1 if back else 1]).alias("path")), "frontier")
        reached = reached.union(frontier)
    return reached


def distances(starts: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """(start, entity_id, distance) of everything within hops relations, in either direction; starts has `start`."""
    edges = undirected(relations)
    reached = starts.select("start", F.col("start").alias("entity_id"), F.lit(0).alias("distance"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(edges, F.col("entity_id") == F.col("src")).select("start", F.col("dst").alias("entity_id")).distinct()
        frontier = step.join(reached, ["start", "entity_id"], "left_anti").withColumn("distance", F.lit(hop))
        reached = reached.union(frontier)
    return reached


def neighborhood(starts: DataFrame, relations: DataFrame, mentions: DataFrame, hops: int = 2, k: int = 50, through_chunks: bool = True, limit: int = LIMIT) -> DataFrame:
    """G1: for each start (start, an entity) the chunks of entities 1 to hops away, by 1 / (1 + distance), k at most.

    Paths run over relations and, through_chunks, over mentions too: two entities of one chunk are
    two edges apart. A chunk counts at the distance of its nearest entity; the start's own chunks
    count only for other entities. Of an entity's chunks only the k of the smallest ids can be
    among a start's k best, since each chunk before them is at least as near; so hubs bring k rows.
    The last step from a node with more than 2k entities is made once for all starts: of the chunks
    of its entities the 2k of the smallest ids hold k that a start's own entity does not bring alone.
    """
    if through_chunks:
        # paths that end in a chunk are no use, so the last step goes to entities only
        own = starts.select(F.concat(F.lit("e:"), F.col("start").cast("string")).alias("start"))
        edges = stored(bipartite(relations, mentions), "edges")
        inner = walked(own, edges, hops - 1, limit)
        ahead, named = inner.where(F.col("distance") == hops - 1).select("start", "node"), edges.where("to LIKE 'e:%'")
        wide = stored(hubs(named, 2 * k), "hubs")
        last = split_join(ahead.join(wide, "node", "left_anti"), named, "node", limit)
        near = inner.where("node LIKE 'e:%'").select("start", "node", "distance").union(last.select("start", F.col("to").alias("node"), F.lit(hops).alias("distance")))
        bare = lambda c: F.substring(c, 3, 1 << 30)
        near = near.groupBy("start", "node").agg(F.min("distance").alias("distance")).select(bare("start").alias("start"), bare("node").alias("entity_id"), "distance")
        near = near.select(F.col("start").cast(starts.schema["start"].dataType).alias("start"), F.col("entity_id").cast(mentions.schema["entity_id"].dataType).alias("entity_id"), "distance")
    else:
        near = distances(starts, relations, hops)
    first = top(mentions.select("entity_id", "child_id").distinct().withColumn("_", F.lit(0)), "_", k, by="entity_id").select("entity_id", "child_id")
    chunks = near.where("distance > 0").join(first, "entity_id").select("start", "child_id", "distance")
    if through_chunks:
        met = named.join(wide, "node").join(first.select(F.concat(F.lit("e:"), F.col("entity_id").cast("string")).alias("to"), "child_id"), "to")
        held = met.groupBy("node", "child_id").agg(F.min("to").alias("_low"), F.max("to").alias("_high")).withColumn("_", F.lit(0))
        shared = split_join(top(held, "_", 2 * k, by="node").drop("_", "rank"), ahead.join(wide, "node", "left_semi"), "node", limit)
        shared = shared.where((F.col("_low") != F.col("start")) | (F.col("_high") != F.col("start")))
        chunks = chunks.union(shared.select(bare("start").cast(starts.schema["start"].dataType).alias("start"), "child_id", F.lit(hops).alias("distance")))
    chunks = chunks.groupBy("start", "child_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("start").orderBy("distance", "child_id")
    ranked = chunks.withColumn("score", 1 / (1 + F.col("distance"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def lookup(entities: DataFrame, mentions: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """(entity_id, child_id) of entities whose name holds the words, whatever the case."""
    found = entities.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if entity_type is not None:
        found = found.where(F.col("entity_type") == entity_type)
    return found.join(mentions, "entity_id").select("entity_id", "name", "child_id").distinct()


def related(entities: DataFrame, relations: DataFrame, name: str, relation_type: str | None = None) -> DataFrame:
    """(entity_id, name, relation_type) of entities with a relation to one whose name holds the words."""
    rel = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    found = entities.where(F.contains(F.lower("name"), F.lit(name.lower()))).select(F.col("entity_id").alias("found"))
    both = rel.select("src", "dst", "relation_type").union(rel.select("dst", "src", "relation_type"))
    other = both.join(found, F.col("src") == F.col("found")).select(F.col("dst").alias("entity_id"), "relation_type").distinct()
    return other.join(entities.select("entity_id", "name"), "entity_id").select("entity_id", "name", "relation_type")


def _named(keywords: DataFrame, entities: DataFrame, limit: int, index: DataFrame | None) -> DataFrame:
    """(query_id, word, place, n, entity_id): entities whose name holds one of a query's keywords; n keywords in all."""
    asked = keywords.select("query_id", F.size("keywords").alias("n"), F.posexplode("keywords").alias("place", "word"))
    pairs = containing(asked.select(F.col("word").alias("keyword")), entities, limit, index).withColumnRenamed("keyword", "word")
    return asked.join(pairs.join(entities.select("name", "entity_id"), "name"), "word").drop("name")


def by_keywords(keywords: DataFrame, entities: DataFrame, mentions: DataFrame, k: int = 50, limit: int = LIMIT, index: DataFrame | None = None) -> DataFrame:
    """By query, chunks by the number of different entities that they mention and whose name holds a keyword.

    keywords (query_id, keywords array). The score is that number over the number of keywords. An
    entity counts once for a query, however many keywords name it, so matches are sums that
    Spark combines before the shuffle. index is grams.posted() of the names, where it is stored.
    """
    hits = _named(keywords, entities, limit, index).groupBy("query_id", "entity_id").agg(F.first("n").alias("n"))
    met = hits.join(mentions.select("entity_id", "child_id").distinct(), "entity_id")
    counted = met.groupBy("query_id", "child_id").agg(F.count("*").alias("matches"), F.first("n").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matches"), "child_id")
    return counted.withColumn("score", F.col("matches") / F.col("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shortest_paths(pairs: DataFrame, relations: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst, distance) of pairs (src, dst) that a path of at most `most` relations joins; see paths() for the nodes."""
    edges = undirected(relations).toDF("node", "to")
    return paths(pairs, edges, most).select("src", "dst", "distance")


def paths(pairs: DataFrame, edges: DataFrame, most: int = 4, limit: int = LIMIT, hub: int = HUB, sign: str | None = None) -> DataFrame:
    """(src, dst, distance, path) of pairs (src, dst) of nodes that at most `most` edges (node, to) join.

    path is the shortest one, from src to dst; of several the least, node by node. Both ends are
    walked half-way, so the frontiers stay near the square root of a one-sided walk: every
    shortest path has exactly one node at the forward walk's last step (or at its end, if it is
    shorter), and the least of the paths joined there is the least of all. The last step from a
    node of more than `hub` edges is made once for all sources: the least way on from it to each
    target follows the way to it. The walk back ends only where a walk forward can meet it.

    With sign, of the ways of a walk to a node the least as a string stays, its nodes joined by sign;
    the whole paths that are left are compared node by node all the same. No node may hold the sign.
    """
    pairs = pairs.select("src", "dst").distinct()
    ahead, behind = (most + 1) // 2, most // 2
    wide = stored(hubs(edges, hub), "hubs")
    apart = lambda level: _apart(level, wide, sign)
    near = walked(pairs.select(F.col("src").alias("start")), edges, ahead, limit, shut=apart, sign=sign)
    before = apart(near.where(F.col("distance") == ahead - 1).select("start", "node", "path")).select(F.col("start").alias("src"), F.col("node").alias("hub"), F.col("path").alias("p1"))
    beyond = edges.join(before.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("hub"), F.col("to").alias("mid"))
    ends = stored(near.where(F.col("distance") == ahead).select(F.col("node").alias("to")).union(beyond.select("mid")).distinct(), "ends")
    far = walked(pairs.select(F.col("dst").alias("start")), edges, behind, limit, back=True, only=ends, sign=sign)
    a = near.select(F.col("start").alias("src"), F.col("node").alias("mid"), F.col("distance").alias("d1"), F.col("path").alias("p1"))
    b = far.select(F.col("start").alias("dst"), F.col("node").alias("mid"), F.col("distance").alias("d2"), F.col("path").alias("p2"))
    way = lambda distance, path: F.struct(distance.cast("int").alias("distance"), path.alias("path")).alias("way")
    met = a.join(b, "mid").where((F.col("d2") == 0) | (F.col("d1") == ahead))
    met = met.select("src", "dst", way(F.col("d1") + F.col("d2"), F.concat("p1", F.slice("p2", 2, most))))
    on = beyond.join(b, "mid").groupBy("hub", "dst").agg(F.min(F.struct("d2", "p2")).alias("on"))
    met = met.union(before.join(on, "hub").select("src", "dst", way(F.col("on.d2") + ahead, F.concat("p1", "on.p2"))))
    best = met.join(pairs, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("way").alias("b"))
    return best.select("src", "dst", "b.distance", "b.path")


def path_chunks(found: DataFrame, mentions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(src, dst, child_id): the chunks that mention an entity on the path of paths() over bipartite() edges, each once for a pair."""
    on = found.select("src", "dst", F.explode("path").alias("_node")).where("_node LIKE 'e:%'")
    on = on.select("src", "dst", F.substring("_node", 3, 1 << 30).cast(mentions.schema["entity_id"].dataType).alias("entity_id"))
    return split_join(on, mentions.select("entity_id", "child_id").distinct(), "entity_id", limit).select("src", "dst", "child_id").distinct()


def from_keywords(keywords: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, k: int = 20, limit: int = LIMIT) -> DataFrame:
    """Keywords name entities, relations add their neighbours, mentions give the chunks.

    A query's first five keywords are asked for; at most max(k // keywords, 1) entities whose name
    holds each of them, by id; chunks by the number of their entities.
    """
    named = _named(keywords, entities, limit, None).where("place < 5")
    order = Window.partitionBy("query_id", "place").orderBy("entity_id")
    most = F.greatest(F.floor(F.lit(k) / F.greatest("n", F.lit(1))), F.lit(1))
    found = named.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", "entity_id").distinct()
    beside = split_join(found, undirected(relations).withColumnRenamed("src", "entity_id"), "entity_id", limit).select("query_id", F.col("dst").alias("entity_id"))
    all_ = found.union(beside).distinct()
    met = split_join(all_, mentions.select("entity_id", "child_id").distinct(), "entity_id", limit)
    counted = met.groupBy("query_id", "child_id").agg(F.count("*").alias("matches"))
    best = Window.partitionBy("query_id").orderBy(F.desc("matches"), "child_id")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


_NODE = "struct<id:string,labels:array<string>,properties:map<string,string>>"
ANSWER = (
    f"nodes array<{_NODE}>, relationships array<struct<startNode:string,endNode:string,type:string,properties:map<string,string>>>, "
    f"path struct<nodes:array<{_NODE}>>, chunk_ids array<string>"
)


def parse_answers(rows: DataFrame, k: int = 50) -> dict[str, DataFrame]:
    """Nodes, edges, paths and chunks of a graph server's answers (query_id, row, json), up to k nodes and chunks a query.

    Of a node's mentions the last one counts, at the place of its first; a node without labels
    is `unknown`, an edge without a type RELATED_TO.
    """
    parsed = rows.select("query_id", "row", F.from_json("json", ANSWER).alias("x"))
    node = parsed.select("query_id", "row", F.posexplode("x.nodes").alias("at", "n"))
    place = F.struct("row", "at")
    label = F.coalesce(F.try_element_at("n.labels", F.lit(1)), F.lit("unknown"))
    nodes = node.select("query_id", F.col("n.id").alias("id"), place.alias("p"), F.struct(label.alias("label"), F.col("n.properties").alias("properties")).alias("v"))
    nodes = nodes.groupBy("query_id", "id").agg(F.min("p").alias("first"), F.max_by("v", "p").alias("v"))
    order = Window.partitionBy("query_id").orderBy("first")
    nodes = nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "v.label", "v.properties", "place")
    edge = parsed.select("query_id", F.explode("x.relationships").alias("r"))
    chunks = parsed.select("query_id", F.explode("x.chunk_ids").alias("chunk_id")).distinct()
    chunks = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("_n") <= k).drop("_n")
    return {
        "nodes": nodes,
        "edges": edge.select("query_id", F.col("r.startNode").alias("src"), F.col("r.endNode").alias("dst"), F.coalesce("r.type", F.lit("RELATED_TO")).alias("relation_type")),
        "paths": parsed.where("x.path is not null").select("query_id", F.transform("x.path.nodes", lambda n: n["id"]).alias("path")),
        "chunks": chunks,
    }
