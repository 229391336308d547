"""Call KPIs, reports and operational metrics, each a conditional aggregate in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import fixed


def dashboard(calls: DataFrame, now: Column, days: int = 7, by: list[str] | None = None) -> DataFrame:
    """A2 to A4: calls of the last `days` and of as many days before, change, trend, active calls."""
    start, before = now - F.expr(f"INTERVAL {days} DAYS"), now - F.expr(f"INTERVAL {2 * days} DAYS")
    when = F.col("started_at")
    now_, past = (when >= start) & (when <= now), (when >= before) & (when < start)
    sums = calls.groupBy(*(by or [])).agg(
        F.count_if(now_).alias("calls"), F.count_if(past).alias("previous_calls"),
        F.avg(F.when(now_, F.col("duration"))).alias("avg_duration"),
        F.count_if(F.col("status").isin(fixed.ACTIVE_STATES)).alias("active_calls"),
    )
    change = F.when(F.col("previous_calls") > 0, (F.col("calls") - F.col("previous_calls")) / F.col("previous_calls") * 100).otherwise(0.0)
    trend = F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("stable")
    return sums.withColumn("change", change).withColumn("trend", trend)


def agent_report(calls: DataFrame, agent: str) -> DataFrame:
    """A5: calls, completed calls and mean duration by agent; calls without an agent are left out."""
    return calls.where(F.col(agent).isNotNull()).groupBy(agent).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "completed").alias("completed"), F.avg("duration").alias("avg_duration")
    )


def report_totals(report: DataFrame) -> DataFrame:
    """Sums over agents; avg_duration is the mean of their means, weighted_duration the mean over calls."""
    return report.agg(
        F.sum("calls").alias("calls"), F.sum("completed").alias("completed"), F.avg("avg_duration").alias("avg_duration"),
        (F.sum(F.col("avg_duration") * F.col("calls")) / F.sum("calls")).alias("weighted_duration"),
    )


def calls_report(calls: DataFrame) -> DataFrame:
    """Totals by direction and by whether a call was answered."""
    return calls.agg(
        F.count("*").alias("total"), F.count_if(F.col("direction") == "inbound").alias("inbound"), F.count_if(F.col("direction") == "outbound").alias("outbound"),
        F.count_if(F.col("status") == "completed").alias("answered"), F.count_if(F.col("status").isin("no_answer", "busy", "failed")).alias("missed"),
        F.avg("duration").alias("avg_duration"),
    )


def breakdown(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts under each bound and in all (+Inf), with sum and count.

    Rows are counted by the first bound that holds them, one group each, and the running sum is
    over the bounds alone.
    """
    v, by = F.col(value), by or []
    slot = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        slot = F.when(v <= bounds[i], i).otherwise(slot)
    named = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    counted = rows.where(v.isNotNull()).groupBy(*by, slot.alias("slot")).agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    groups = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sum("n").alias("count"), F.sum("s").alias("sum"))
    spread = groups.select(*by, "m", "count", "sum", F.posexplode(named).alias("i", "le"))
    under = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda t, j: t + F.coalesce(F.try_element_at("m", j), F.lit(0).cast("long")))
    return spread.select(*by, "le", under.alias("bucket"), "count", "sum")


def timing(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, total, least, most and mean."""
    return rows.groupBy(*by).agg(*(f(value).alias(n) for n, f in (("count", F.count), ("total", F.sum), ("least", F.min), ("most", F.max), ("mean", F.avg))))


def stage_shares(rows: DataFrame, value: str, by: str, stage: str) -> DataFrame:
    """Each stage's part of its group's total, in percent."""
    sums = rows.groupBy(by, stage).agg(F.sum(value).alias("total"))
    whole = F.sum("total").over(Window.partitionBy(by))
    return sums.withColumn("share", F.when(whole != 0, F.col("total") / whole * 100).otherwise(0.0))


def rates(events: DataFrame, when: str, by: list[str], window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events a minute over sliding windows."""
    minutes = F.lit(float(window.split()[0]))
    counted = events.groupBy(F.window(when, window, slide or window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n", (F.col("n") / minutes).alias("per_minute"))


def bucket_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """A quantile from cumulative buckets (le, bucket, count), linear inside the bucket that holds it.

    In the +Inf bucket it is the largest bound.
    """
    bound = F.col("le").cast("double")
    rows = buckets.where("le <> '+Inf'").withColumn("b", bound)
    order = Window.partitionBy().orderBy("b")
    prior = rows.select("b", "bucket", "count", F.coalesce(F.lag("b").over(order), F.lit(0.0)).alias("b0"), F.coalesce(F.lag("bucket").over(order), F.lit(0)).alias("n0"))
    target = F.col("count") * q
    inside = F.when((F.col("bucket") >= target) & (F.col("bucket") > F.col("n0")), F.col("b0") + (F.col("b") - F.col("b0")) * (target - F.col("n0")) / (F.col("bucket") - F.col("n0")))
    return prior.agg(F.coalesce(F.min(inside), F.max("b")).alias("quantile"))


def prometheus(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Exposition lines, one a row."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels))
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int = 10, sizes: DataFrame | None = None) -> DataFrame:
    """By query, NDCG, reciprocal rank, precision and recall at k.

    ranked (query_id, child_id, rank), relevant (query_id, child_id). sizes (query_id, relevant): how
    many are relevant to each query, where that is known; relevant then needs only those that are ranked.
    """
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("relevant")) if sizes is None else sizes
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "child_id"], "left")
    gain = F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    sums = hits.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    joined = sums.join(sizes, "query_id").where("relevant > 0")
    return joined.select(
        "query_id", (F.col("dcg") / best).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("relevant")).alias("recall"),
    )


def positive_mean(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The mean of the values above zero, 0 without any."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("mean"))


def subscriber_counts(subscriptions: DataFrame) -> DataFrame:
    """Different subscribers of each channel."""
    return subscriptions.groupBy("channel").agg(F.countDistinct("subscriber").alias("subscribers"))
