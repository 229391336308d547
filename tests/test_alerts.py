"""Counter rates against a plain loop, resets, and alerts that hold."""

from __future__ import annotations

import random
from itertools import pairwise

from pyspark.sql import functions as F

from ravine.operators import alerts

SCHEMA = "series string, at_ms long, value double"


def expected(samples, window, every):
    out = {}
    for name in {s for s, _, _ in samples}:
        seen = {}
        for s, t, v in samples:
            if s == name and t is not None and v is not None:
                seen[t] = max(v, seen.get(t, v))
        rows = sorted(seen.items())
        for tick in range(0, max(t for t, _ in rows) + window + every, every):
            inside = [(t, v) for t, v in rows if tick - window < t <= tick]
            if len(inside) < 2:
                continue
            rise = sum(b - a if b >= a else b for (_, a), (_, b) in pairwise(inside))
            span = (inside[-1][0] - inside[0][0]) / 1000
            mean = span / (len(inside) - 1)
            old, new = (inside[0][0] - tick + window) / 1000, (tick - inside[-1][0]) / 1000
            old = old if old < mean * 1.1 else mean / 2
            new = new if new < mean * 1.1 else mean / 2
            if rise > 0:
                old = min(old, span * inside[0][1] / rise)
            out[name, tick] = (len(inside), rise, round(rise * ((span + old + new) / span) / (window / 1000), 9))
    return out


def test_rates_with_resets_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [("a", None, 1.0), ("a", 5, None)]
    for name in "abc":
        value, at = 0.0, 0
        for _ in range(120):
            at += rng.choice([1000, 15_000, 15_000, 400_000])
            value = 0.0 if rng.random() < 0.1 else value + rng.randrange(4)
            rows += [(name, at, value)] * rng.choice([1, 1, 2])
    rows += [("b", 15_000, 3.0), ("b", 15_000, 9.0), ("z", 40, 2.0)]
    for slot in (300_000, 700_000, 86_400_000):
        got = alerts.counter_rates(spark.createDataFrame(rows, SCHEMA), ["series"], slot_ms=slot).collect()
        assert {(r.series, r.tick_ms): (r.samples, r.increase, round(r.per_second, 9)) for r in got} == expected(rows, 300_000, 30_000)


def test_alert_fires_when_it_has_held(spark):
    ticks = [0, 30, 60, 90, 120, 150, 240, 270, 600]
    rates = spark.createDataFrame([("a", t * 1000, 0.1) for t in ticks] + [("a", 180_000, 0.01), ("b", 0, None)], "series string, tick_ms long, per_second double")
    states = alerts.alert_states(rates, ["series"], F.col("per_second") * 60 > 5, 120_000)
    assert [r.tick_ms for r in states.where("state = 'firing'").orderBy("tick_ms").collect()] == [120_000, 150_000]
    got = alerts.alert_episodes(states, ["series"]).orderBy("since_ms").collect()
    assert [tuple(r) for r in got] == [("a", 0, 120_000, 150_000, 6), ("a", 240_000, None, 270_000, 2), ("a", 600_000, None, 600_000, 1)]


def test_no_samples(spark):
    none = alerts.counter_rates(spark.createDataFrame([], SCHEMA), ["series"])
    assert alerts.alert_episodes(alerts.alert_states(none, ["series"], F.col("per_second") > 0, 0), ["series"]).count() == 0
