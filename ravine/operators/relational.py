"""The relational side: customers, calls, tasks, facts, scripts, campaigns, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.functions import text as tx


def by_phone(customers: DataFrame, phone: str) -> DataFrame:
    """The number as given, cleaned, or cleaned without its plus sign."""
    clean = phone.translate(str.maketrans("", "", " -()"))
    return customers.where(F.col("phone").isin(phone, clean, clean.lstrip("+")))


def search(customers: DataFrame, phrase: str, *columns: str, k: int = 10, order: str = "name") -> DataFrame:
    """P5: customers with the phrase in one of the columns, newest or first by order."""
    from ravine.operators.lexical import any_contains

    return any_contains(customers, phrase, *columns).orderBy(order).limit(k)


def history(calls: DataFrame, by: str, when: str, tie: str, k: int = 10) -> DataFrame:
    """The last k calls of each customer, newest first."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(when), F.col(tie).desc())
    return calls.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pending(tasks: DataFrame, customers: DataFrame, key: str) -> DataFrame:
    """Open tasks with their customer, by due date (nulls last) and priority."""
    return tasks.where("status = 'pending'").join(customers, key, "left").orderBy(F.asc_nulls_last("due_date"), F.desc_nulls_first("priority"))


def overdue(tasks: DataFrame, now: Column) -> DataFrame:
    """Open tasks that were due before `now`."""
    return tasks.where((F.col("status") == "pending") & (F.col("due_date") < now))


def bucketed_facts(facts: DataFrame, by: str) -> DataFrame:
    """A10: facts by customer and bucket; types without a bucket, and none, are other."""
    bucket = F.when(F.col("fact_type").isin(fixed.FACT_TYPES), F.col("fact_type")).otherwise("other")
    return facts.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("facts"), F.sort_array(F.collect_list("content")).alias("contents"))


def without(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has not been dealt with yet."""
    return rows.join(done.select(*key), key, "left_anti")


def within(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(keys.select(*key), key, "left_semi")


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page and, on each row, the number of all rows. Sorting keeps offset + limit rows a task."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def keyset(rows: DataFrame, order: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The rows after the cursor in the order of the columns, and has_more on each."""
    if cursor is not None:
        after = F.struct(*(F.col(c) for c in order)) > F.struct(*(F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(order, cursor)))
        rows = rows.where(after)
    more = rows.orderBy(*order).limit(limit + 1)
    flag = more.agg((F.count("*") > limit).alias("has_more"))
    return more.orderBy(*order).limit(limit).join(F.broadcast(flag))


def free_slots(slots: DataFrame, busy: DataFrame, by: str) -> DataFrame:
    """Slots (start, end) that no busy interval of their calendar overlaps.

    Intervals are put into day buckets, so the overlap test only meets intervals of the same days.
    """
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    taken = busy.select(F.col(by).alias("_by"), F.col("start").alias("_s"), F.col("end").alias("_e"), days("start", "end").alias("_day"))
    spread = slots.withColumn("_day", days("start", "end"))
    met = (F.col(by) == F.col("_by")) & (spread["_day"] == taken["_day"]) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    clash = spread.join(taken, met, "left_semi").select(by, "start", "end").distinct()
    return slots.join(clash, [by, "start", "end"], "left_anti")


def open_hours(when: Column, days: Column, start: Column, end: Column) -> Column:
    """Whether a time lies in a schedule; times that cannot be read allow it."""
    time = F.date_format(when, "HH:mm")
    fits = (time >= start) & (time <= end)
    readable = start.rlike("^[0-2][0-9]:[0-5][0-9]$") & end.rlike("^[0-2][0-9]:[0-5][0-9]$")
    return F.array_contains(days, F.lower(F.date_format(when, "EEE"))) & F.coalesce(F.when(readable, fits), F.lit(True))


def transcripts(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text", customer: str = "user") -> DataFrame:
    """By call, `ROLE: text` lines in order, and the customer's words alone."""
    turn = F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))
    sorted_ = turns.groupBy(by).agg(F.array_sort(F.collect_list(turn)).alias("_t"), F.count("*").alias("turns"))
    lines = F.transform("_t", lambda x: F.concat(F.upper(x["r"]), F.lit(": "), F.coalesce(x["t"], F.lit(""))))
    own = F.transform(F.filter("_t", lambda x: x["r"] == customer), lambda x: F.coalesce(x["t"], F.lit("")))
    return sorted_.select(by, "turns", F.array_join(lines, "\n").alias("transcript"), F.array_join(own, " ").alias("customer_text"))


def outcomes(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Every call with its outcome and sentiment."""
    return calls.withColumns({"outcome": tx.outcome(F.col(transcript)), "sentiment": tx.sentiment(F.col(transcript))})


def prefetch(customers: DataFrame, facts: DataFrame, calls: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Each customer with 10 facts, the last call and 5 open tasks; each side is cut before it is joined."""
    def most(rows: DataFrame, order: list[Column], k: int, value: str, name: str) -> DataFrame:
        n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k)
        return n.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(name))

    sides = [most(facts, [F.desc("created_at"), F.col("content")], 10, "content", "facts"), most(calls, [F.desc("call_date"), F.col("summary")], 1, "summary", "last_calls"), most(tasks, [F.asc_nulls_last("due_date"), F.col("description")], 5, "description", "tasks")]
    for s in sides:
        customers = customers.join(s, key, "left")
    return customers


def route(numbers: DataFrame, establishments: DataFrame, runtimes: DataFrame, agents: DataFrame) -> DataFrame:
    """A number's establishment and runtime, and its agent if there is one."""
    return numbers.join(establishments, "establishment_id").join(runtimes, "establishment_id").join(agents, "agent_id", "left")
