"""Tiles, escalation and merges of scanned pages against plain versions."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ravine.operators import scans
from ravine.plans.signal_queries import tile_readings

D = "/root/testdata/sf0.001"


def grid(spark, *sizes):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "k int, width int, height int")
    rows = scans.tiles(df).orderBy("k", "tile").collect()
    return [[(r.x1, r.y1, r.x2, r.y2) for r in rows if r.k == i] for i in range(len(sizes))]


def test_tiles_cover_the_image_and_meet(spark):
    small, square, wide, huge, none, null = grid(spark, (500, 400), (1800, 1800), (3000, 1200), (20_000, 20_000), (0, 7), (None, 5))
    assert small == [(0, 0, 500, 400)] and none == null == []
    assert square[:2] == [(0, 0, 1024, 1024), (776, 0, 1800, 1024)]
    for tiles, w, h in ((square, 1800, 1800), (wide, 3000, 1200)):
        assert all(x2 - x1 == 1024 and y2 - y1 == 1024 for x1, y1, x2, y2 in tiles) and len(set(tiles)) == len(tiles)
        assert max(t[2] for t in tiles) == w and max(t[3] for t in tiles) == h
        for x in range(0, w, 37):
            for y in range(0, h, 37):
                assert any(a <= x < c and b <= y < d for a, b, c, d in tiles)
    assert len(huge) == 16
    step = int(896 * math.sqrt(23 * 23 / 16))
    assert huge[1][0] == step


def test_only_large_images_are_cut(spark):
    df = spark.createDataFrame([(1499, 10), (1500, 10), (10, 1500), (None, 2000)], "width int, height int")
    got = df.select(scans.tiled(F.col("width"), F.col("height"))).collect()
    assert [r[0] for r in got] == [False, True, True, None]


def test_escalation(spark):
    rows = [
        (1, "base", 0.7, "a", None), (1, "large", 0.9, "b", None),
        (2, "base", 0.9, "a", "timeout"), (2, "large", 0.6, "b", None), (2, "gundam", 0.9, "c", None),
        (3, "base", 0.1, "a", None), (3, "large", 0.5, "b", None), (3, "gundam", 0.2, "c", None),
        (4, "tiny", 0.99, "weaker than the first", None), (4, "base", None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, mode string, confidence double, text string, error string")
    got = {r.k: (r.mode, r.text, r.retry_count) for r in scans.escalated(df, "k").collect()}
    assert got == {1: ("base", "a", 0), 2: ("large", "b", 1), 3: ("gundam", "c", 2), 4: ("base", None, 0)}
    assert scans.escalated(df.where("k = 3"), "k", retries=1).first().mode == "large"


def like(a, b):
    return SequenceMatcher(None, a, b).ratio()


def plain(how, tiles):
    """Every pair of lines is compared, without bounds."""
    if len(tiles) == 1:
        return tiles[0][0]
    lines = [(x.strip(), c) for t, c in tiles for x in t.split("\n") if x.strip()]
    if how == "fuzzy":
        out = []
        for x, _ in lines:
            if all(like(x, o) < 0.85 for o in out[-10:]):
                out.append(x)
        return "\n".join(out)
    kept = []
    for x, c in lines:
        scores = [like(x.lower(), o.lower()) for o, _ in kept]
        at = scores.index(max(scores)) if scores and max(scores) >= 0.85 else None
        if at is None:
            kept.append((x, c))
        elif c > kept[at][1]:
            del kept[at]
            kept.append((x, c))
    return "\n".join(x for x, _ in kept)


@pytest.mark.parametrize("how", ["fuzzy", "vote"])
def test_merge_of_whole_pages_equals_all_pairs(spark, how):
    readings = tile_readings(spark, D)
    tiles = {}
    for r in readings.orderBy("page_id", "tile").collect():
        tiles.setdefault(r.page_id, []).append((r.text, r.confidence))
    got = {r.page_id: r.text for r in scans.merged(readings, "page_id", how).collect()}
    assert got == {k: plain(how, t) for k, t in tiles.items()}
    assert sum(len(t) > 1 for t in tiles.values()) > 20


def test_vote_takes_the_surer_reading(spark):
    rows = [(1, 0, "The quick brown fox\nonly left", 0.6), (1, 1, "The quick brown fax\nonly right", 0.9), (1, 1, "The quick brown fax\nonly right", 0.9), (2, 0, " as it is ", 0.0), (3, 0, None, None), (3, 1, "x", 0.5)]
    df = spark.createDataFrame(rows, "page int, tile int, text string, confidence double").withColumn("_rows", F.lit(1))
    got = {r.page: (r.text, round(r.confidence, 6), r.tiles) for r in scans.merged(df, "page", "vote").collect()}
    assert got == {1: ("only left\nThe quick brown fax\nonly right", 0.75, 2), 2: (" as it is ", 0.0, 1), 3: ("x", 0.5, 2)}
    got = {r.page: r.text for r in scans.merged(df, "page", "fuzzy").collect()}
    assert got[1] == "The quick brown fox\nonly left\nonly right"
    got = {r.page: r.text for r in scans.merged(df, "page", "concat").collect()}
    assert got == {1: "The quick brown fox\nonly left\n\nThe quick brown fax\nonly right", 2: "as it is", 3: "x"}
    assert scans.merged(df.limit(0), "page", "vote").count() == 0
    with pytest.raises(ValueError):
        scans.merged(df, "page", "best")
