"""Rates of counters over sliding windows, and alerts that must hold before they fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _steps(samples: DataFrame, by: list[str], window_ms: int, slot_ms: int) -> DataFrame:
    """(by, at_ms, value, step) of every sample: what the counter rose by since the one before.

    A counter that falls was reset and has risen from zero. A step counts only in windows that
    hold both samples, so a series is cut into slots of time, each with the last window_ms of the
    slot before it, and a hot series is spread over tasks.
    """
    slot = F.floor(F.col("at_ms") / slot_ms)
    late = F.floor((F.col("at_ms") + window_ms) / slot_ms)
    dealt = samples.select(*by, "at_ms", "value", F.explode(F.sequence(slot, late)).alias("_slot"))
    order = Window.partitionBy(*by, "_slot").orderBy("at_ms", "value")
    once = dealt.withColumn("_next", F.lead("at_ms").over(order)).where("_next is null or _next <> at_ms")
    before = F.lag("value").over(order)
    step = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return once.withColumn("step", step).where(F.col("_slot") == slot).drop("_slot", "_next")


def counter_rates(samples: DataFrame, by: list[str], window_ms: int = 300_000, every_ms: int = 30_000, slot_ms: int = 86_400_000) -> DataFrame:
    """(by, tick_ms, samples, increase, per_second) of counters (by, at_ms, value) at every tick.

    A tick's window is open at its old end and closed at the tick; it needs two samples. The
    increase between its first and last sample, resets included, is extended to the window's ends:
    whole if a sample is near (1.1 mean distances), else by half a distance, and not further back
    than where the counter was zero. Null times and values are left out; samples of a series at one
    time count once, with the largest value. slot_ms must be window_ms or more.
    """
    if slot_ms < window_ms:
        raise ValueError("a slot is shorter than the window")
    kept = samples.where("at_ms is not null and value is not null and not isnan(value)").withColumn("value", F.col("value").cast("double"))
    at = F.col("at_ms")
    first_tick = F.ceil(at / every_ms) * every_ms
    last_tick = F.floor((at + window_ms - 1) / every_ms) * every_ms
    met = _steps(kept, by, window_ms, slot_ms).where(first_tick <= last_tick)
    ticks = met.withColumn("tick_ms", F.explode(F.sequence(first_tick, last_tick, F.lit(every_ms).cast("long"))))
    sums = ticks.groupBy(*by, "tick_ms").agg(
        F.count("*").alias("samples"), F.min("at_ms").alias("_first"), F.max("at_ms").alias("_last"), F.sum("step").alias("_steps"),
        F.min_by("step", "at_ms").alias("_step"), F.min_by("value", "at_ms").alias("_value"),
    ).where("samples > 1")
    # the first sample's own step leads back out of the window
    rise = sums.withColumns({"increase": F.col("_steps") - F.col("_step"), "_span": (F.col("_last") - F.col("_first")) / 1000.0})
    mean = F.col("_span") / (F.col("samples") - 1)
    old, new = (F.col("_first") - F.col("tick_ms") + window_ms) / 1000.0, (F.col("tick_ms") - F.col("_last")) / 1000.0
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    zero = F.when(F.col("increase") > 0, F.col("_span") * F.col("_value") / F.col("increase"))
    whole = F.col("_span") + F.least(near(old), zero) + near(new)
    return rise.select(*by, "tick_ms", "samples", "increase", (F.col("increase") * (whole / F.col("_span")) / (window_ms / 1000.0)).alias("per_second"))


def alert_states(rates: DataFrame, by: list[str], breach: Column, hold_ms: Column | int, every_ms: int = 30_000) -> DataFrame:
    """(by, tick_ms, since_ms, state) at ticks where `breach` is true: pending, and firing once it has held for hold_ms.

    A tick without a breach, or without a rate, ends the alert. Rows are one a series and tick,
    so a series' history is short however many samples it has.
    """
    order = Window.partitionBy(*by).orderBy("tick_ms")
    on = rates.where(breach).withColumn("_run", F.col("tick_ms") - F.row_number().over(order) * F.lit(every_ms).cast("long"))
    since = F.min("tick_ms").over(Window.partitionBy(*by, "_run"))
    held = on.withColumn("since_ms", since)
    hold = hold_ms if isinstance(hold_ms, Column) else F.lit(hold_ms)
    return held.withColumn("state", F.when(F.col("tick_ms") - F.col("since_ms") >= hold, "firing").otherwise("pending")).drop("_run")


def alert_episodes(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, since_ms, fired_ms, last_ms, ticks): each stretch of an alert; fired_ms is null if it never fired."""
    fired = F.min(F.when(F.col("state") == "firing", F.col("tick_ms")))
    return states.groupBy(*by, "since_ms").agg(fired.alias("fired_ms"), F.max("tick_ms").alias("last_ms"), F.count("*").alias("ticks"))
