"""Joins on hot keys, containment by q-grams, and walks through shared chunks, against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ravine.operators import graph
from ravine.operators.grams import containing
from ravine.operators.hot import split_join


def test_split_join(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hub", "a", "b", None]), i) for i in range(40)]
    right = [(rng.choice(["hub"] * 9 + ["a", "c", None]), 100 + i % 150) for i in range(300)]
    got = split_join(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), "k", limit=10).collect()
    want = [(k, x, y) for k, x in left for j, y in right if k == j and k is not None]
    assert sorted((r.k, r.x, r.y) for r in got) == sorted(want)


def test_containing(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abÇé %_") for _ in range(n))
    names = [word(rng.randrange(0, 12)) for _ in range(300)] + [None, "", "same", "same", "x" * 5000]
    words = [word(rng.randrange(0, 5)) for _ in range(120)] + [None, "", "SAME", "xxx", "zzz", "x" * 4000]
    got = containing(spark.createDataFrame([(w,) for w in words], "keyword string"), spark.createDataFrame([(n,) for n in names], "name string"), limit=5)
    want = {(w, n) for w in words for n in names if w and n and w.lower() in n.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def walk(edges, start, most):
    """Every node's least shortest path."""
    best, frontier = {start: [start]}, {start: [start]}
    for _ in range(most):
        step = {}
        for node, path in frontier.items():
            for to in edges.get(node, ()):
                if to not in best:
                    step[to] = min(step.get(to, [*path, to]), [*path, to])
        best |= step
        frontier = step
    return best


@pytest.fixture(scope="module")
def world(spark):
    """Entities 0 to 29, one chunk that mentions very many, one entity that very many chunks mention."""
    rng = random.Random(3)
    relations = [(f"{rng.randrange(30)}", f"{rng.randrange(30)}", "R") for _ in range(12)]
    mentions = [(f"{rng.randrange(30)}", rng.randrange(40)) for _ in range(25)] + [(f"{e}", 99) for e in range(0, 30, 2)] + [("7", c) for c in range(40, 90)]
    edges = {}
    for a, b, _ in relations:
        edges.setdefault(f"e:{a}", set()).add(f"e:{b}")
        edges.setdefault(f"e:{b}", set()).add(f"e:{a}")
    for e, c in mentions:
        edges.setdefault(f"e:{e}", set()).add(f"c:{c}")
        edges.setdefault(f"c:{c}", set()).add(f"e:{e}")
    return edges, mentions, spark.createDataFrame(relations, "src string, dst string, relation_type string"), spark.createDataFrame(mentions, "entity_id string, child_id long")


@pytest.mark.parametrize("hops,k", [(1, 50), (2, 50), (2, 4), (3, 10)])
def test_neighborhood(spark, world, hops, k):
    edges, mentions, relations, met = world
    starts = spark.createDataFrame([(str(i),) for i in range(30)], "start string")
    got = sorted((r.start, r["rank"], r.child_id, r.distance) for r in graph.neighborhood(starts, relations, met, hops, k, limit=3).collect())
    want = []
    for s in map(str, range(30)):
        near = {}
        for node, path in walk(edges, f"e:{s}", hops).items():
            if node.startswith("e:") and len(path) > 1:
                for e, c in mentions:
                    if f"e:{e}" == node:
                        near[c] = min(near.get(c, 99), len(path) - 1)
        want += [(s, i + 1, c, dist) for i, (dist, c) in enumerate(sorted((dist, c) for c, dist in near.items())[:k])]
    assert got == sorted(want)


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_paths(spark, world, most):
    edges, mentions, relations, met = world
    pairs = list(itertools.product([f"e:{i}" for i in range(0, 30, 3)], [f"e:{i}" for i in range(0, 30, 4)]))
    found = graph.paths(spark.createDataFrame(pairs, "src string, dst string"), graph.bipartite(relations, met), most, limit=3)
    got = {(r.src, r.dst): (r.distance, r.path) for r in found.collect()}
    want = {}
    for s, t in pairs:
        path = walk(edges, s, most).get(t)
        if path:
            want[s, t] = (len(path) - 1, path)
    assert got == want
    chunks = {(r.src, r.dst, r.child_id) for r in graph.path_chunks(found, met, limit=3).collect()}
    assert chunks == {(s, t, c) for (s, t), (_, path) in want.items() for e, c in mentions if f"e:{e}" in path}


@pytest.mark.parametrize("hops,k", [(1, 1), (2, 1), (3, 2)])
def test_neighborhood_past_hubs(spark, world, hops, k):
    """Nodes of three or five entities and more are hubs here."""
    test_neighborhood(spark, world, hops, k)


@pytest.mark.parametrize("hub", [0, 1, 3])
@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_paths_past_hubs(spark, world, most, hub, monkeypatch):
    plain = graph.paths
    monkeypatch.setattr(graph, "paths", lambda *a, **k: plain(*a, **k, hub=hub))
    test_paths(spark, world, most)


def string_walk(edges, start, most, back):
    """By node, the path whose steps are least as strings."""
    best, frontier = {start: [start]}, {start: [start]}
    for _ in range(most):
        step = {}
        for node, path in frontier.items():
            for to in set(edges.get(node, ())) - set(best):
                own = [to, *path] if back else [*path, to]
                step[to] = min(step.get(to, own), own, key=">".join)
        best |= step
        frontier = step
    return best


@pytest.mark.parametrize("hub", [1, 64])
def test_paths_by_strings(spark, hub):
    """c:1 comes before c:12, but c:12> before c:1>; whole paths are compared node by node."""
    rng = random.Random(5)
    mentions = sorted({(f"{rng.randrange(1, 25)}", rng.choice([1, 12, 121, 2, 21, 3])) for _ in range(45)})
    edges = {}
    for e, c in mentions:
        edges.setdefault(f"e:{e}", set()).add(f"c:{c}")
        edges.setdefault(f"c:{c}", set()).add(f"e:{e}")
    pairs = list(itertools.product([e for e in sorted(edges) if e[0] == "e"], repeat=2))
    none, met = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame(mentions, "entity_id string, child_id long")
    found = graph.paths(spark.createDataFrame(pairs, "src string, dst string"), graph.bipartite(none, met), 4, hub=hub, sign=">")
    got = {(r.src, r.dst): r.path for r in found.collect()}
    want = {}
    for s, t in pairs:
        a, b = string_walk(edges, s, 2, False), string_walk(edges, t, 2, True)
        ways = [a[x] + b[x][1:] for x in set(a) & set(b) if x == t or len(a[x]) == 3]
        if ways:
            want[s, t] = min(ways, key=lambda p: (len(p), p))
    assert got == want
    assert sum(path != walk(edges, s, 4)[t] for (s, t), path in want.items()) > 10


@pytest.mark.parametrize("search", ["paths", "neighborhood"])
def test_a_hub_is_not_expanded_for_each_start(spark, monkeypatch, search):
    n, sizes, plain = 150, [], graph.split_join

    def counted(*a):
        out = plain(*a)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "split_join", counted)
    leaves = spark.range(n).select(F.col("id").cast("string").alias("src"))
    relations = leaves.select("src", F.lit("N").alias("dst"), F.lit("R").alias("relation_type"))
    mentions = leaves.select(F.col("src").alias("entity_id"), (F.col("src").cast("long") * 10).alias("child_id"))
    if search == "paths":
        pairs = leaves.select(F.concat(F.lit("e:"), "src").alias("src"), F.lit("e:0").alias("dst"))
        got = graph.paths(pairs, graph.bipartite(relations, mentions), 4)
        assert {(r.src, r.distance) for r in got.collect()} == {(f"e:{i}", 2 if i else 0) for i in range(n)}
    else:
        got = graph.neighborhood(leaves.withColumnRenamed("src", "start"), relations, mentions, 2, 3)
        near = {i: [10 * j for j in range(4) if j != i][:3] for i in range(n)}
        assert sorted((int(r.start), r.child_id) for r in got.collect()) == sorted((i, c) for i in near for c in near[i])
    assert max(sizes) < 10 * n


def test_keywords_are_contained(spark):
    """Containment and not equality; five keywords of each query in the fallback."""
    entities = spark.createDataFrame([("1", "Acme Corp"), ("2", "Acmeville"), ("3", "Corporate"), ("4", None)], "entity_id string, name string")
    met = spark.createDataFrame([("1", 10), ("1", 10), ("2", 10), ("3", 11), ("4", 12)], "entity_id string, child_id long")
    asked = spark.createDataFrame([(1, ["acme", "corp"]), (2, ["CORP", "zzz"]), (3, []), (4, ["z1", "z2", "z3", "z4", "z5", "acme"])], "query_id int, keywords array<string>")
    got = {(r.query_id, r.child_id): (r.matches, r.score) for r in graph.by_keywords(asked, entities, met).collect()}
    assert got == {(1, 10): (2, 1.0), (1, 11): (1, 0.5), (2, 10): (1, 0.5), (2, 11): (1, 0.5), (4, 10): (2, 2 / 6)}
    none = spark.createDataFrame([], "src string, dst string")
    back = {(r.query_id, r.child_id): r.matches for r in graph.from_keywords(asked, entities, none, met).collect()}
    assert back == {(1, 10): 2, (1, 11): 1, (2, 10): 1, (2, 11): 1}
    assert graph.by_keywords(asked, entities.where(F.lit(False)), met).count() == 0
