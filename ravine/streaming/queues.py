"""Subscribers' bounded queues as state of a stream."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Queue(StatefulProcessor):
    """What a subscriber's queue holds, has been given, and has dropped."""

    def __init__(self, key: str, order: str, most: int):
        self.key, self.order, self.most = key, order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "held int, given long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, given, dropped = self.state.get() if self.state.exists() else (0, 0, 0)
        first: list[int] = []  # the `most` smallest, negated, so that the largest goes first
        came = taken = 0
        for frame in rows:
            events = frame[self.order].dropna()
            came += len(events) + int(frame["more"].fillna(0).sum())
            taken += int(frame["taken"].fillna(0).sum())
            for e in events.nsmallest(self.most):
                heapq.heappush(first, -int(e))
                if len(first) > self.most:
                    heapq.heappop(first)
        held = max(held - taken, 0)
        kept = sorted(-e for e in first)[: self.most - held]
        lost = came - len(kept)
        self.state.update((held + len(kept), given + len(kept), dropped + lost))
        places = [*range(given + 1, given + len(kept) + 1)]
        out = pd.DataFrame({self.key: key[0], self.order: pd.array(kept, "Int64"), "place": pd.array(places, "Int64"), "dropped": pd.array([None] * len(kept), "Int64")})
        if lost:
            note = pd.DataFrame({self.key: [key[0]], self.order: pd.array([None], "Int64"), "place": pd.array([None], "Int64"), "dropped": pd.array([dropped + lost], "Int64")})
            out = pd.concat([out, note]) if kept else note
        if len(out):
            yield out

    def close(self) -> None:
        pass


def _first(order: str, most: int):
    """Of a micro-batch's (channel, order, more) in one task, the `most` first events of each channel, and how many more came."""

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        more: Counter[str] = Counter()
        for frame in frames:
            for channel, own in frame.groupby("channel"):
                more[channel] += int(own["more"].fillna(0).sum())
                came = [*held.get(channel, []), *map(int, own[order].dropna())]
                held[channel] = heapq.nsmallest(most, came)
                more[channel] += len(came) - len(held[channel])
        for channel, events in held.items():
            counts = [None] * len(events) + [more[channel]]
            yield pd.DataFrame({"channel": channel, order: pd.array([*events, None], "Int64"), "more": pd.array(counts, "Int64")})

    return first


def _subscribed(subscriptions: DataFrame) -> DataFrame:
    """(subscriber, channel), each once; who has `all` needs no other channel, and so gets no event twice."""
    every = subscriptions.where("channel = 'all'").select("subscriber").distinct()
    others = subscriptions.where("channel <> 'all' and subscriber is not null").distinct().join(every, "subscriber", "left_anti")
    return others.select("subscriber", "channel").unionByName(every.where("subscriber is not null").withColumn("channel", F.lit("all")))


def queued(events: DataFrame, subscriptions: DataFrame, taken: DataFrame | None = None, most: int = 100, order: str = "event_id") -> DataFrame:
    """T5, T6, as a stream: (subscriber, order, place, dropped) of what each subscriber's queue takes in.

    events (order, a whole number, and channel) is a stream, subscriptions (subscriber, channel) a
    table; a subscriber of `all` gets every event, events without a channel too. A queue holds at most `most`
    events across micro-batches. taken (subscriber, n), a stream of its own, tells that a subscriber
    took n events out. In a micro-batch these count first; then the events come in their order
    until the queue is full, and the others are dropped. place numbers a subscriber's events; a
    row with a null event carries the number dropped so far, once for each micro-batch that dropped some.

    A task keeps `most` event numbers of a channel or a subscriber, however many come: the shuffle to the
    subscribers has `most` events of each of their channels, and a count of the others. Without taken the result over all
    micro-batches is that of fan_out(), if events come in their order. Sets the session's state store to
    RocksDB, which this kind of state needs.
    """
    spark = events.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    named = events.select(F.col(order).cast("long").alias(order), F.explode(F.array_compact(F.array_distinct(F.array("channel", F.lit("all"))))).alias("channel")).where(F.col(order).isNotNull())
    # no queue takes more than a channel's first `most` events, so others are only counted: in each task, then by channel
    kind = f"channel string, {order} long, more long"
    few = named.select("channel", order, F.lit(None).cast("long").alias("more")).mapInPandas(_first(order, most), kind)
    few = few.repartition("channel").mapInPandas(_first(order, most), kind)
    rows = few.join(_subscribed(subscriptions), "channel").select("subscriber", order, F.lit(None).cast("int").alias("taken"), "more")
    if taken is not None:
        rows = rows.unionByName(taken.where("n > 0 and subscriber is not null").select("subscriber", F.lit(None).cast("long").alias(order), F.col("n").cast("int").alias("taken"), F.lit(None).cast("long").alias("more")))
    kind = subscriptions.schema["subscriber"].dataType.simpleString()
    return rows.groupBy("subscriber").transformWithStateInPandas(
        statefulProcessor=_Queue("subscriber", order, most), outputStructType=f"subscriber {kind}, {order} long, place long, dropped long",
        outputMode="append", timeMode="none",
    )
