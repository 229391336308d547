"""Queues across micro-batches: the batch's result, room after takes, restarts."""

from __future__ import annotations

import random

from ravine.streaming import events as ev
from ravine.streaming.queues import queued

EVENTS = "event_id long, channel string"


def run(spark, tmp_path, subs, most, takes=False):
    """One micro-batch a file; what is new since the last run."""
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    taken = read("takes", "subscriber string, n int") if takes else None
    out = queued(read("in", EVENTS), subs, taken, most)
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    return spark.read.schema("subscriber string, event_id long, place long, dropped long").parquet(str(tmp_path / "out"))


def add(spark, tmp_path, rows, name="in", schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    subs = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "all"), ("y", "a"), ("z", "c"), ("w", "none"), (None, "a")], "subscriber string, channel string")
    for k in range(0, 120, 40):
        part = rows[k : k + 40]
        rng.shuffle(part)
        add(spark, tmp_path, part)
        got = run(spark, tmp_path, subs, 30)  # each run goes on from the checkpoint
    want = ev.fan_out(spark.createDataFrame(rows, EVENTS), subs.where("subscriber is not null"), 30)
    key = lambda df: sorted((r.subscriber, r.event_id, r.place) for r in df.where("event_id is not null").collect())
    assert key(got) == key(want)
    lost = {r.subscriber: r.n for r in got.where("dropped is not null").groupBy("subscriber").agg({"dropped": "max"}).toDF("subscriber", "n").collect()}
    reached = {"x": sum(c in ("a", "b") for _, c in rows), "y": 120, "z": sum(c == "c" for _, c in rows)}
    assert lost == {s: n - 30 for s, n in reached.items() if n > 30}


def test_takes_make_room(spark, tmp_path):
    subs = spark.createDataFrame([("x", "a")], "subscriber string, channel string")
    takes = "subscriber string, n int"
    add(spark, tmp_path, [(i, "a") for i in range(5)])
    add(spark, tmp_path, [], "takes", takes)
    run(spark, tmp_path, subs, 3, takes=True)
    add(spark, tmp_path, [(i, "a") for i in range(5, 10)])
    add(spark, tmp_path, [("x", 2), ("x", None), (None, 1), ("q", 7)], "takes", takes)
    got = run(spark, tmp_path, subs, 3, takes=True).collect()
    assert sorted((r.event_id, r.place) for r in got if r.event_id is not None) == [(0, 1), (1, 2), (2, 3), (5, 4), (6, 5)]
    assert sorted(r.dropped for r in got if r.dropped is not None) == [2, 5]


def test_few_events_reach_the_subscribers(spark, tmp_path):
    """The shuffle to the subscribers has a channel's first events and a count, not every event for every subscriber."""
    subs = spark.createDataFrame([(f"s{i}", "a") for i in range(40)], "subscriber string, channel string")
    add(spark, tmp_path, [(i, "a") for i in range(500)])
    out = queued(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), subs, None, 5)
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    got = spark.read.schema("subscriber string, event_id long, place long, dropped long").parquet(str(tmp_path / "out"))
    assert got.where("event_id < 5").count() == 200 and got.where("dropped = 495").count() == 40
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInPandas") == 2
