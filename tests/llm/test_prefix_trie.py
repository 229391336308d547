"""The conversation trie against one that is walked node by node."""

from __future__ import annotations

import hashlib
import random
import zlib

from ravine.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(convs: dict[int, list[tuple[str, str]]]):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(path)))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def ordered(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=60, deep=40):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), n):
        length = rng.choice([0, 1, 2, 3, 5, 8, deep])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "bcé"])) for t in range(length + 1)]
    return rows


def test_against_walk(spark):
    rows = made(1) + [(None, 0, "user", "x"), (7, None, None, None), (7, 3, "user", None), (7, 3, "user", None), (900, 0, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as depth", "2 as owner", "3 as weight", "'x' as block")
    own = ordered(rows)
    assert rows_of(pt.conversation_trie(df)) == plain(own)
    assert rows_of(pt.rebuilt_trie(df)) == plain(rebuild(own))


def test_one_long_chain_and_copies(spark):
    """One conversation holds most turns, many are equal, one has no turns of its own."""
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in range(2, 40) for t in range(3)] + [(50, t, "user", "t0") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(pt.conversation_trie(df))
    assert got == plain(ordered(rows))
    assert max(r[1] for r in got) == 300
    # rebuilt conversation 103 keeps nothing where its turns are fewer than h and its family has no first
    few = [(c, 0, "user", "x") for c in range(101, 140)]
    assert rows_of(pt.rebuilt_trie(spark.createDataFrame(few, SCHEMA))) == plain(rebuild(ordered(few)))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pt.conversation_trie(df).collect() == [] and pt.rebuilt_trie(df).collect() == []
