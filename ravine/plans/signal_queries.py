"""Queries on metrics, on scanned pages and through table functions of SQL, each beside its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.operators import alerts, scans, sql_functions
from ravine.plans import oracles as sql
from ravine.plans import stand_ins as si
from ravine.plans.oracles import ORACLE_SQL
from ravine.plans.queries import query
from ravine.sources.tables import table
from ravine.sources.versions import shared_folder
from ravine.streaming.queues import queued

#: Windows of the queries: events are rarer than a monitor's samples.
WINDOW, EVERY, HOLD = 6 * 3_600_000, 30 * 60_000, 2 * 3_600_000
#: (alert, event type, events a minute, held for): the alerts of the queries.
RULES = [("errors", "error", 0.0021, HOLD), ("clicks", "click", 0.0033, HOLD // 2), ("purchases", "purchase", 0.0105, EVERY), ("busy views", "view", 0.0517, HOLD)]


def _counters(s: SparkSession, d: str) -> DataFrame:
    """Counters of event types, sampled at each event; every one begins again at midnight."""
    e = si.events(s, d).select("event_type", "event_id", F.unix_millis("ts").alias("at_ms"))
    return e.selectExpr("event_type", "at_ms", "CAST(count(*) OVER (PARTITION BY event_type, at_ms DIV 86400000 ORDER BY at_ms, event_id) AS DOUBLE) AS value")


_RATES = f"""
c AS (SELECT event_type, (epoch_us(ts) // 1000) AS at_ms, count(*) OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) // 86400000 ORDER BY (epoch_us(ts) // 1000), event_id)::DOUBLE AS value FROM events),
o AS (SELECT event_type, at_ms, max(value) AS value FROM c GROUP BY 1, 2),
t AS (SELECT *, unnest(range((((at_ms + {EVERY} - 1) // {EVERY}) * {EVERY})::BIGINT, (at_ms + {WINDOW})::BIGINT, {EVERY})) AS tick_ms FROM o),
l AS (SELECT *, lag(value) OVER (PARTITION BY event_type, tick_ms ORDER BY at_ms) AS prior FROM t),
g AS (SELECT event_type, tick_ms, count(*) AS samples, sum(CASE WHEN prior IS NULL THEN 0 WHEN value >= prior THEN value - prior ELSE value END) AS increase,
  min(at_ms) AS f, max(at_ms) AS z, arg_min(value, at_ms) AS v, (max(at_ms) - min(at_ms)) / 1000.0::DOUBLE AS span FROM l GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT *, span / (samples - 1) AS mean, (f - tick_ms + {WINDOW}) / 1000.0::DOUBLE AS a, (tick_ms - z) / 1000.0::DOUBLE AS b FROM g),
r AS (SELECT event_type, tick_ms, samples, increase, increase * ((span + least(CASE WHEN a < mean * 1.1::DOUBLE THEN a ELSE mean / 2 END, CASE WHEN increase > 0 THEN span * v / increase END)
  + CASE WHEN b < mean * 1.1::DOUBLE THEN b ELSE mean / 2 END) / span) / {WINDOW / 1000}::DOUBLE AS per_second FROM m)"""


@query
def counter_rates(s: SparkSession, d: str) -> DataFrame:
    """Rates of counters that are reset each midnight, in sliding windows."""
    out = alerts.counter_rates(_counters(s, d), ["event_type"], WINDOW, EVERY)
    return out.select("event_type", "tick_ms", "samples", "increase", F.expr("floor(per_second * 60e6D + 0.5D) / 1e6D").alias("per_minute"))


ORACLE_SQL["counter_rates"] = f"WITH {_RATES} SELECT event_type, tick_ms, samples, increase, floor(per_second * 60e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS per_minute FROM r"


@query
def alert_episodes(s: SparkSession, d: str) -> DataFrame:
    """The stretches of each alert, with the tick from which it fired."""
    rules = s.createDataFrame(RULES, "alert string, event_type string, most double, hold_ms long")
    rates = alerts.counter_rates(_counters(s, d), ["event_type"], WINDOW, EVERY).join(F.broadcast(rules), "event_type")
    states = alerts.alert_states(rates, ["alert"], F.col("per_second") * 60 > F.col("most"), F.col("hold_ms"), EVERY)
    return alerts.alert_episodes(states, ["alert"])


_RULES = ", ".join(f"('{a}', '{t}', {m}::DOUBLE, {h})" for a, t, m, h in RULES)
ORACLE_SQL["alert_episodes"] = f"""
WITH {_RATES}, rules(alert, event_type, most, hold_ms) AS (VALUES {_RULES}),
n AS (SELECT alert, hold_ms, tick_ms, tick_ms - {EVERY} * row_number() OVER (PARTITION BY alert ORDER BY tick_ms) AS run FROM r JOIN rules USING (event_type) WHERE per_second * 60 > most),
s AS (SELECT *, min(tick_ms) OVER (PARTITION BY alert, run) AS since_ms FROM n)
SELECT alert, since_ms, min(tick_ms) FILTER (tick_ms - since_ms >= hold_ms) AS fired_ms, max(tick_ms) AS last_ms, count(*) AS ticks FROM s GROUP BY 1, 2"""


_SIZES = "page_id, CAST(100 + length(html) * 7 % 6000 AS INT) AS width, CAST(100 + length(html) * 13 % 9000 AS INT) AS height"


@query
def image_tiles(s: SparkSession, d: str) -> DataFrame:
    """Tiles of the pages as images, sized by their length, where they are large."""
    images = table(s, d, "pages").selectExpr(*_SIZES.split(", "))
    return scans.tiles(images.where(scans.tiled(F.col("width"), F.col("height"))))


ORACLE_SQL["image_tiles"] = f"""
WITH i AS (SELECT {_SIZES} FROM pages), n AS (SELECT *, ceil(width / 896) * ceil(height / 896) AS n FROM i WHERE greatest(width, height) >= 1500),
s AS (SELECT *, CASE WHEN n > 16 THEN floor(896 * sqrt(n / 16)) ELSE 896 END::INT AS step FROM n),
r AS (SELECT *, unnest(range(ceil(height / step)::INT)) AS r FROM s), c AS (SELECT *, unnest(range(ceil(width / step)::INT)) AS c FROM r),
a AS (SELECT *, CASE WHEN c * step + 1024 >= width THEN greatest(0, width - 1024) ELSE c * step END AS x1, CASE WHEN r * step + 1024 >= height THEN greatest(0, height - 1024) ELSE r * step END AS y1 FROM c),
u AS (SELECT page_id, width, height, x1, y1, min(r * 100 + c) AS o FROM a GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS tile FROM u)
SELECT page_id, width, height, tile, x1, y1, least(x1 + 1024, width) AS x2, least(y1 + 1024, height) AS y2 FROM p WHERE tile < 16"""


def tile_readings(s: SparkSession, d: str) -> DataFrame:
    """(page_id, tile, text, confidence): the lines of each page in at most 16 tiles that share three lines.

    Every second tile misreads `an` and `n,`; confidences go round.
    """
    bare = F.regexp_replace("html", r"[\s\p{Z}]+", " ")
    lines = F.filter(F.transform(F.split(bare, "<[^>]*>"), lambda x: F.trim(x)), lambda x: x != "")
    pages = table(s, d, "pages").select("page_id", lines.alias("lines")).where("size(lines) > 0").withColumn("step", F.greatest(F.lit(6), F.ceil(F.size("lines") / 16)).cast("int"))
    cut = pages.select("page_id", "lines", "step", F.explode(F.sequence(F.lit(0), F.ceil(F.size("lines") / F.col("step")).cast("int") - 1)).alias("tile"))
    text = F.array_join(F.slice("lines", F.col("tile") * F.col("step") + 1, F.col("step") + 3), "\n")
    wrong = F.replace(F.replace(text, F.lit("an"), F.lit("am")), F.lit("n,"), F.lit("n."))
    return cut.select("page_id", "tile", F.when(F.col("tile") % 2 == 1, wrong).otherwise(text).alias("text"), F.element_at(F.array(*map(F.lit, (0.875, 0.5, 0.625))), F.col("tile") % 3 + 1).alias("confidence"))


@query
def tile_texts_joined(s: SparkSession, d: str) -> DataFrame:
    """C23, concat."""
    return scans.merged(tile_readings(s, d), "page_id", "concat").select("page_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "tiles")


ORACLE_SQL["tile_texts_joined"] = r"""
WITH l AS (SELECT page_id, list_filter(list_transform(string_split_regex(regexp_replace(html, '[\s\p{Z}]+', ' ', 'g'), '<[^>]*>'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pages),
s AS (SELECT *, greatest(6, ceil(len(ls) / 16))::INT AS step FROM l WHERE len(ls) > 0), c AS (SELECT *, unnest(range(ceil(len(ls) / step)::INT)) AS tile FROM s),
t AS (SELECT page_id, tile, array_to_string(ls[tile * step + 1 : tile * step + step + 3], chr(10)) AS text, [0.875::DOUBLE, 0.5, 0.625][tile % 3 + 1] AS confidence FROM c)
SELECT page_id, md5(string_agg(CASE WHEN tile % 2 = 1 THEN replace(replace(text, 'an', 'am'), 'n,', 'n.') ELSE text END, chr(10) || chr(10) ORDER BY tile)) AS text_md5, round(avg(confidence), 6) AS confidence, count(*) AS tiles
FROM t GROUP BY 1"""


@query
def tile_texts_without_repeats(s: SparkSession, d: str) -> DataFrame:
    """C23, fuzzy; no SQL has its measure of similarity."""
    return scans.merged(tile_readings(s, d), "page_id", "fuzzy")


@query
def tile_texts_by_vote(s: SparkSession, d: str) -> DataFrame:
    """C23, vote; no SQL has its measure of similarity."""
    return scans.merged(tile_readings(s, d), "page_id", "vote")


@query
def reading_escalation(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages, whose readings get better by mode; every ninth reading fails."""
    modes = F.explode(F.array(*map(F.lit, scans.MODES))).alias("mode")
    read = table(s, d, "documents").select("doc_id", "n_chars", modes).withColumn("place", F.array_position(F.array(*map(F.lit, scans.MODES)), F.col("mode")))
    sure = (F.col("n_chars") * 31 % 97 + F.col("place") * 20) / F.lit(200.0)
    error = F.when((F.col("doc_id") + F.col("place")) % 9 == 0, "timeout")
    rows = read.select("doc_id", "mode", F.when(error.isNull(), sure).otherwise(0.0).alias("confidence"), F.concat("mode", F.lit(" reading")).alias("text"), error.alias("error"))
    return scans.escalated(rows, "doc_id").select("doc_id", "mode", F.round("confidence", 6).alias("confidence"), "error", "retry_count")


ORACLE_SQL["reading_escalation"] = """
WITH r AS (SELECT doc_id, m, (doc_id + m) % 9 = 0 AS bad, CASE WHEN (doc_id + m) % 9 = 0 THEN 0 ELSE (n_chars * 31 % 97 + m * 20) / 200.0::DOUBLE END AS c FROM documents, (VALUES (3), (4), (5)) v(m)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT bad AND c >= 0.6::DOUBLE DESC, CASE WHEN NOT bad AND c >= 0.6::DOUBLE THEN m ELSE -m END) AS n FROM r)
SELECT doc_id, ['base', 'large', 'gundam'][m - 2] AS mode, round(c, 6) AS confidence, CASE WHEN bad THEN 'timeout' END AS error, m - 3 AS retry_count FROM p WHERE n = 1"""


def _asked(s: SparkSession, d: str, call: str) -> DataFrame:
    """Every question answered by a table function."""
    sql_functions.register(s, si.lexical_index(s, d), si.hashed_vectors(s, d))
    return s.sql(f"SELECT query_id, a.* FROM {{questions}} q, LATERAL {call} a", questions=si.questions(s, d))


@query
def lexical_search_function(s: SparkSession, d: str) -> DataFrame:
    """lexical_search() of SQL."""
    return _asked(s, d, "lexical_search(q.text, 10)")


ORACLE_SQL["lexical_search_function"] = f"WITH {sql._BM25} SELECT query_id, child_id, score, rank FROM br WHERE rank <= 10"


@query
def hybrid_search_function(s: SparkSession, d: str) -> DataFrame:
    """hybrid_search() of SQL."""
    return _asked(s, d, "hybrid_search(q.text, 20)")


ORACLE_SQL["hybrid_search_function"] = f"""
WITH {sql._BM25}, qv AS {sql._hashed("item_id", "benchmark").replace("::FLOAT::DOUBLE", "")}, dv AS {sql._hashed("doc_id", "documents")},
near AS (SELECT qv.id AS query_id, dv.id AS child_id, round(sum(qv.x * dv.x), 6) AS score FROM qv JOIN dv USING (dim) GROUP BY 1, 2),
sr AS (SELECT query_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM near WHERE score <> 0),
fused AS (SELECT query_id, child_id, l.rank AS lexical_rank, s.rank AS semantic_rank, round(coalesce(0.7::DOUBLE / (60 + l.rank), 0) + coalesce(0.8::DOUBLE / (60 + s.rank), 0), 9) AS score
  FROM (SELECT * FROM br WHERE rank <= 50) l FULL JOIN (SELECT * FROM sr WHERE rank <= 50) s USING (query_id, child_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM fused)
SELECT query_id, child_id, score, rank, lexical_rank, semantic_rank FROM r WHERE rank <= 20"""


@query
def fanout_stream(s: SparkSession, d: str) -> DataFrame:
    """T5, T6, as fanout_bounded, with the queues as state of a stream over the events."""
    schema = table(s, d, "events").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", F.col("event_type").alias("channel"))
    first = table(s, d, "events").groupBy("user_id").agg(F.min("event_type").alias("first"))
    subs = first.select(F.col("user_id").alias("subscriber"), F.when(F.col("user_id") % 50 == 0, "all").otherwise(F.col("first")).alias("channel"))
    home = f"{shared_folder(s)}/queues-{uuid4().hex}"
    got = queued(events, subs)
    stream = got.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).format("parquet").start(f"{home}/rows")
    stream.awaitTermination()
    return s.read.schema(got.schema).parquet(f"{home}/rows").where("event_id is not null").select("subscriber", "event_id", "place")


ORACLE_SQL["fanout_stream"] = ORACLE_SQL["fanout_bounded"]
