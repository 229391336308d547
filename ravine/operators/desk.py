"""The desk's reads and writes: customers, calls, tasks, facts, scripts, knowledge, calendars, members.

A write takes the table and a batch of changes and gives the table to store, or the rows to
append, so a batch of any size is one plan. Whether a key is there is asked by a join, never row
by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.functions import text as tx
from ravine.operators.grams import containing
from ravine.operators.hot import split_join
from ravine.operators.ingest import first_of_each


def changed(rows: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with the columns' new values where changes (key, columns) have one; a null changes nothing, and unknown keys add nothing."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = rows.join(new, rows[key] == F.col("_key"), "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in rows.columns))


def set_status(customers: DataFrame, changes: DataFrame, key: str = "customer_id") -> tuple[DataFrame, DataFrame]:
    """(customers, rejected): statuses outside the pipeline's are rejected and change nothing."""
    valid = F.col("status").isin(fixed.CUSTOMER_STATUSES)
    return changed(customers, changes.where(valid), key, "status"), changes.where(~F.coalesce(valid, F.lit(False)))


def record_calls(new: DataFrame, calls: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls to append, customers to create, failed) for new calls (call_id, customer_id, customer_phone, ...).

    Calls that are recorded already are passed over. A call without a known customer_id gets the
    customer with its phone, as given or cleaned, the smallest id if several have it; where there
    is none a customer named Unknown Caller is created, once for each cleaned phone. A call with
    neither, and one whose customer_id is not there, fails.
    """
    fresh = first_of_each(new.join(calls.select("call_id"), "call_id", "left_anti"), ["call_id"], "customer_id", "customer_phone")
    known = F.when(F.col("customer_id") != "unknown", F.col("customer_id"))
    fresh = fresh.withColumns({"customer_id": known, "_clean": tx.phone_clean(F.col("customer_phone"))})
    by_id, without = fresh.where("customer_id is not null"), fresh.where("customer_id is null and customer_phone is not null")
    ids = customers.select("customer_id")
    named = by_id.join(ids, "customer_id", "left_semi").select(*fresh.columns)
    phones = customers.where("phone is not null").groupBy(F.col("phone").alias("_phone")).agg(F.min("customer_id").alias("_id"))
    as_given = without.join(phones, without.customer_phone == phones._phone, "left").drop("_phone").withColumnRenamed("_id", "_given")
    found = as_given.join(phones, as_given._clean == phones._phone, "left").withColumn("customer_id", F.coalesce("_given", "_id"))
    unknown = found.where("customer_id is null").select("_clean").distinct()
    created = unknown.select(F.concat(F.lit("new:"), "_clean").alias("customer_id"), F.col("_clean").alias("phone"), F.lit("Unknown Caller").alias("name"), F.lit("new").alias("status"))
    matched = found.withColumn("customer_id", F.coalesce("customer_id", F.concat(F.lit("new:"), "_clean"))).select(*fresh.columns)
    failed = by_id.join(ids, "customer_id", "left_anti").select("call_id").union(fresh.where("customer_id is null and customer_phone is null").select("call_id"))
    return named.union(matched).drop("_clean"), created, failed


def completed(tasks: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Tasks with the status completed and the time of it, for the ids in done (task_id)."""
    hit = tasks.join(done.select("task_id").distinct().withColumn("_done", F.lit(True)), "task_id", "left")
    out = hit.withColumns({"completed_at": F.when(F.col("_done"), now).otherwise(F.col("completed_at")), "status": F.when(F.col("_done"), "completed").otherwise(F.col("status"))})
    return out.select(*tasks.columns)


def created_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks and new ones: pending, of medium priority where none is given; a description is needed."""
    made = new.where("coalesce(trim(description), '') <> ''").withColumns(
        {"status": F.lit("pending"), "priority": F.coalesce("priority", F.lit("medium")), "completed_at": F.lit(None).cast("timestamp")}
    )
    return tasks.unionByName(made.select(*tasks.columns))


def with_facts(facts: DataFrame, added: DataFrame, dropped: DataFrame) -> DataFrame:
    """facts (fact_id, ...) with those added, but without the ids in dropped (fact_id)."""
    return facts.unionByName(added).join(dropped.select("fact_id"), "fact_id", "left_anti")


def current_scripts(scripts: DataFrame, *by: str) -> DataFrame:
    """The newest active script of each call type (and industry)."""
    return first_of_each(scripts.where("active"), list(by), F.desc_nulls_last("created_at"), F.col("script_id"))


def handlers(scripts: DataFrame) -> DataFrame:
    """(call_type, script_id, objection_key, response): every handler of the given scripts."""
    return scripts.select("call_type", "script_id", F.explode("objection_handlers").alias("objection_key", "response"))


def objection_answers(asked: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each question (call_type, objection_key) with the newest active script's answer, or what that script could answer.

    Where the call type has no active script, script_id and available are null.
    """
    now = current_scripts(scripts, "call_type").select("call_type", "script_id", "objection_handlers")
    rows = asked.join(now, "call_type", "left")
    response = F.try_element_at("objection_handlers", F.col("objection_key"))
    available = F.when(response.isNull(), F.sort_array(F.map_keys("objection_handlers")))
    return rows.select("call_type", "objection_key", "script_id", response.alias("response"), available.alias("available"))


def attendees(asked: DataFrame, connections: DataFrame) -> DataFrame:
    """Each name (org_id, name) with the calendar that holds it: of its own organisation first, else of any.

    Equal matches go to the default calendar, then by name. Names meet by their rarest q-gram.
    """
    wanted = asked.where("name <> ''")
    held = connections.where("attendee_name <> ''").withColumnRenamed("org_id", "_org")
    pairs = containing(wanted.select(F.col("name").alias("keyword")), held.select(F.col("attendee_name").alias("name")))
    met = split_join(pairs.select(F.col("name").alias("attendee_name"), F.col("keyword").alias("name")), held, "attendee_name")
    met = split_join(wanted, met, "name")
    order = [F.desc(F.col("_org") == F.col("org_id")), F.desc("is_default"), F.col("attendee_name"), F.col("attendee_email")]
    return first_of_each(met, ["org_id", "name"], *order).select("org_id", "name", "attendee_name", "attendee_email")


def listed(connections: DataFrame) -> DataFrame:
    """Each organisation's attendees, the default first, then by name, with their place."""
    order = Window.partitionBy("org_id").orderBy(F.desc("is_default"), "attendee_name", "attendee_email")
    return connections.withColumn("place", F.row_number().over(order))


def conflicts(asked: DataFrame, busy: DataFrame, by: str) -> DataFrame:
    """Each asked interval (by, start, end) with the number of busy ones that it overlaps, and the first of them.

    Intervals meet by day, and a pair that shares several days counts on the first.
    """
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b)))
    taken = busy.select(F.col(by).alias("_by"), F.col("start").alias("_s"), F.col("end").alias("_e"), days("start", "end").alias("_day"))
    spread = asked.withColumn("_on", days("start", "end"))
    overlap = (F.col(by) == F.col("_by")) & (F.col("_on") == F.col("_day")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))
    met = spread.join(taken, overlap).where(F.col("_day") == F.greatest(F.to_date("start"), F.to_date("_s")))
    found = met.groupBy(by, "start", "end").agg(F.count("*").alias("conflicts"), F.min("_s").alias("first_conflict"))
    return asked.join(found, [by, "start", "end"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def members(users: DataFrame, memberships: DataFrame, org: Column | None = None) -> DataFrame:
    """Users with their memberships, of one organisation if org is given."""
    rows = memberships if org is None else memberships.where(F.col("org_id") == org)
    return users.join(rows, "user_id")


def active_calls(calls: DataFrame) -> DataFrame:
    """Calls that have not ended, the newest first within each customer."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("started_at"), F.desc("call_id"))
    return calls.where(F.col("status").isin(fixed.ACTIVE_STATES)).withColumn("place", F.row_number().over(order))


def by_outcome(calls: DataFrame, k: int) -> DataFrame:
    """The k newest calls of each outcome."""
    order = Window.partitionBy("outcome").orderBy(F.desc_nulls_last("started_at"), F.desc("call_id"))
    return calls.where("outcome is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def transcript_pages(turns: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Turns of each call, size to a page, with the cursor (the last turn) of the page and whether more follow."""
    w = Window.partitionBy(by).orderBy(order)
    placed = turns.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    pages = placed.groupBy(by, "page").agg(F.count("*").alias("turns"), F.max(order).alias("cursor"))
    return pages.withColumn("has_more", F.lead("page").over(Window.partitionBy(by).orderBy("page")).isNotNull())


def knowledge_written(rows: DataFrame, added: DataFrame, changes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Knowledge (id, title, content, category) with rows added, changed where not null, and dropped by id."""
    kept = rows.unionByName(added).join(dropped.select("id"), "id", "left_anti")
    return changed(kept, changes, "id", "title", "content", "category")


def tool_logs(logs: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The k newest entries of each call's tool log, with their place."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(order), F.desc("event_id"))
    return logs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def legacy_search(knowledge: DataFrame, phrase: str, category: str | None = None, k: int = 5) -> DataFrame:
    """Knowledge with the phrase in title, content or keywords, most used first; its relevance is always 0."""
    from ravine.operators.lexical import any_contains

    rows = any_contains(knowledge, phrase, "title", "content", "keywords")
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows.withColumn("relevance_rank", F.lit(0)).orderBy(F.desc_nulls_last("access_count"), "id").limit(k)


PLAN = "keywords array<string>, semantic_query_text string, cypher_query string, requires_graph boolean, intent string, weights map<string,double>"


def parse_plans(answers: DataFrame) -> DataFrame:
    """Q3: a planner's answers (query_id, text, answer) as plans; what is missing comes from the query and the defaults.

    A code fence goes first. If the rest is no JSON, the first braces without braces within are
    tried; if these are none either, everything is missing.
    """
    body = F.trim("answer")
    lines = F.split(body, "\n")
    last = F.size(lines) - F.when(F.try_element_at(lines, F.lit(-1)) == "```", 2).otherwise(1)
    bare = F.when(F.startswith(body, F.lit("```")), F.array_join(F.slice(lines, 2, F.greatest(last, F.lit(0))), "\n")).otherwise(body)
    inner = F.regexp_extract(bare, "(?s)\\{[^{}]*\\}", 0)
    whole, part = F.from_json(bare, PLAN), F.from_json(inner, PLAN)
    broken = F.try_parse_json(bare).isNull()
    x = F.when(broken, part).otherwise(whole)
    weights = F.create_map(F.lit("lexical"), F.lit(fixed.LEXICAL_WEIGHT), F.lit("semantic"), F.lit(fixed.SEMANTIC_WEIGHT), F.lit("graph"), F.lit(fixed.GRAPH_WEIGHT))
    plan = answers.withColumn("_x", x)
    return plan.select(
        "query_id", F.coalesce("_x.keywords", tx.keywords(F.col("text"))).alias("keywords"), F.coalesce("_x.semantic_query_text", "text").alias("semantic_query"),
        F.col("_x.cypher_query").alias("graph_query"), F.coalesce("_x.requires_graph", F.lit(False)).alias("requires_graph"),
        F.coalesce("_x.intent", F.lit("general")).alias("intent"), F.coalesce("_x.weights", weights).alias("weights"),
    )


def default_plan(queries: DataFrame) -> DataFrame:
    """Q5: the plan of a query (query_id, text) when planning is skipped: its words, itself, no graph."""
    parts = F.filter(F.split(F.col("text"), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    return queries.select("query_id", parts.alias("keywords"), F.col("text").alias("semantic_query"), F.lit(False).alias("requires_graph"))
