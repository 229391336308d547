"""Call events as streams: idempotent append, routing, state, windows, bounded fan-out, final states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def once(events: DataFrame, key: list[str], when: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key once. With `when`, within the watermark, so that state is bounded; else exactly and for ever."""
    if when is None:
        return events.dropDuplicates(key)
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark(key)


def routed(types: dict[str, Callable[[DataFrame], None]], every: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every event to one sink, and each type's events to the type's own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            every(batch)
            for kind, sink in types.items():
                sink(batch.where(F.col("event_type") == kind))
        finally:
            batch.unpersist()

    return write


def states(events: DataFrame, key: str, when: str, state: str = "event_type") -> DataFrame:
    """Each call's first and last time and last state, by event time."""
    return events.groupBy(key).agg(F.min(when).alias("first_at"), F.max(when).alias("last_at"), F.max_by(state, when).alias("state"), F.count("*").alias("events"))


def windowed(events: DataFrame, when: str, window: str, value: str, late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """KPIs by window of event time."""
    return (
        events.withWatermark(when, late).groupBy(F.window(when, window), *(by or []))
        .agg(F.count("*").alias("events"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("start"), *(by or []), "events", "total", "mean")
    )


def sessions(events: DataFrame, when: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of a key's events without a gap."""
    return (
        events.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), by)
        .agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def fan_out(events: DataFrame, subscriptions: DataFrame, most: int = 100, order: str = "event_id") -> DataFrame:
    """Each subscriber's events, of its channel or of `all`; beyond `most` the newest are dropped.

    subscriptions (subscriber, channel). For a micro-batch or a batch. No subscriber gets more
    than a channel's first `most` events, so channels are cut to these before they are joined.
    """
    first = Window.partitionBy("channel").orderBy(order)
    named = events.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("place")
    every = events.withColumn("channel", F.lit("all")).orderBy(order).limit(most)
    got = named.where("channel <> 'all'").unionByName(every).join(subscriptions.distinct(), "channel").dropDuplicates(["subscriber", order])
    queue = Window.partitionBy("subscriber").orderBy(order)
    return got.withColumn("place", F.row_number().over(queue)).where(F.col("place") <= most)


def dropped(events: DataFrame, key: str, when: str, order: str, final: list[str], late: str, state: str = "event_type") -> DataFrame:
    """T9, in batch: by key, events that came more than `late` behind the newest so far, and final states after the first.

    In a stream the first is the watermark's numRowsDroppedByWatermark of the query's progress.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumns({"_newest": F.max(when).over(before), "_final": F.col(state).isin(final)})
    marked = marked.withColumn("_finals", F.count_if("_final").over(before))
    return marked.groupBy(key).agg(
        F.count_if(F.col(when) < F.col("_newest") - F.expr(f"INTERVAL {late}")).alias("late_event_dropped"),
        F.count_if(F.col("_final") & (F.col("_finals") > 0)).alias("duplicate_final_dropped"),
    )


def final_states(events: DataFrame, key: str, when: str, pending: list[str], state: str = "event_type") -> DataFrame:
    """T7, in batch: the last event of each key and whether its state is final."""
    last = events.groupBy(key).agg(F.max_by(state, when).alias("state"), F.max(when).alias("at"))
    return last.withColumn("final", ~F.col("state").isin(pending))


def await_final(events: DataFrame, key: str, pending: list[str], timeout_ms: int, state: str = "event_type") -> DataFrame:
    """T7, as a stream: a row when a key's state is final, or the last state when it has waited timeout_ms."""
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            yield pd.DataFrame({key: [group[0]], "state": [last], "timed_out": [True]})
            return
        seen = [s for f in frames for s in f[state]]
        final = next((s for s in seen if s not in pending), None)
        if final is not None:
            if held.exists:
                held.remove()
            yield pd.DataFrame({key: [group[0]], "state": [final], "timed_out": [False]})
        elif seen:
            held.update((seen[-1],))
            held.setTimeoutDuration(timeout_ms)

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, timed_out boolean", "state string", "append", "ProcessingTimeTimeout")


def server_events(kind: Column, data: Column) -> Column:
    """`event: ...`, `data: ...` and an empty line."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def drained(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all there is, batch by batch, and stop (T8 with a trigger of its own for loops)."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
