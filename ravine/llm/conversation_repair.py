"""Repair of conversations at the least cost: which turns to keep, to give another role, to delete, and where to insert one.

A conversation has to end up as nothing, or as an optional system turn before pairs of a user's
and an assistant's turn. Conversations are dealt by id and sorted by turn once; the cheapest edits
are found by dynamic programming over a stream of the sorted rows, whatever their number:

1. backward, from the last turn to the first, a row needs only four costs, those of the rest of
   the conversation from each state of the pattern. It leaves a backpointer, one byte for all
   four states: for each the least letter among the cheapest moves, so that following the
   backpointers from the start gives the ASCII-least of the cheapest edits;
2. forward, from the first turn to the last, the backpointers are followed.

The state is carried from one Arrow batch to the next. Between the two passes Spark's own sort
turns the partition around; it spills the rows with their backpointers once they outgrow memory,
so a conversation of any length takes a batch of memory, and no file is written beside Spark's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravine.llm.common import crc32_sql

#: Costs of the edits; a row that was cut off costs TRUNCATED more unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# states of the pattern (s?(ua)+)?: at the start, after the system's turn, after a user's, after an assistant's
_ENDS = (0, 3)
_USER = {0: 2, 1: 2, 3: 2}
_NEXT = {**_USER, 2: 3}  #: after the one turn of a user or an assistant that fits
_KEPT = ({0: 1}, _USER, {2: 3}, {})  #: by kind: s, u, a, another initial
_FAR = 1 << 40
_MUST_GO = 8  #: kinds: 0 to 3 as in _KEPT, 4 more if truncated; blank and duplicate rows have to go
_MOVES = "DIKR"


def _with_inserts(costs: list[int], moves: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs and moves once an insertion may come first; two in a row are the most that can help."""
    for _ in range(2):
        for state in range(4):
            other = INSERT + costs[_NEXT[state]]
            if (other, 1) < (costs[state], moves[state]):
                costs[state], moves[state] = other, 1
    return tuple(costs), sum(m << 2 * i for i, m in enumerate(moves))


_LAST = _with_inserts([0 if s in _ENDS else _FAR for s in range(4)], [3] * 4)


@cache
def _step(after: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int, int]:
    """Costs from a row on, less their least one, that least one, and the row's backpointers; after: the costs behind it.

    Costs differ by two insertions at most, so there are few different ones to remember.
    """
    costs, moves = [], []
    for state in range(4):
        tried = [(DELETE + after[state], 0)]
        if kind < _MUST_GO:
            cut = TRUNCATED if kind & 4 else 0
            if state in _KEPT[kind & 3]:
                tried.append((cut + after[_KEPT[kind & 3][state]], 2))
            tried.append((cut + REROLE + after[_NEXT[state]], 3))
        cost, move = min(tried)
        costs.append(cost)
        moves.append(move)
    costs, back = _with_inserts(costs, moves)
    least = min(costs)
    return tuple(c - least for c in costs), least, back


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last to the first of each conversation, with their backpointers."""
    now, costs, begun = None, None, False
    for batch in batches:
        back = bytearray(batch.num_rows)
        for i, (conv, kind) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist())):
            if not begun or conv != now:
                now, costs, begun = conv, _LAST[0], True
            costs, _, back[i] = _step(costs, kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, type=pa.int16())], names=[*batch.schema.names, "back"])


def _forward(schema: pa.Schema):
    """The edits of rows from the first to the last of each conversation."""

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state, place, before = None, False, 0, 0, None
        out: list[list] = [[] for _ in schema]
        held = 0

        def put(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def inserted(back: int) -> None:
            nonlocal state, place
            while back >> 2 * state & 3 == 1:
                place += 1
                put(now, place, None, "user" if _NEXT[state] == 2 else "assistant", "", "I", None, INSERT, False)
                state = _NEXT[state]

        def full() -> pa.RecordBatch:
            nonlocal out, held
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
            out, held = [[] for _ in schema], 0
            return made

        for batch in batches:
            columns = [batch.column(c) for c in ("turn", "role", "text", "kind", "fault", "back")]
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                turn, role, text, kind, fault, back = (c[i].as_py() for c in columns)
                if not begun or conv != now:
                    if begun:
                        inserted(_LAST[1])
                    now, begun, state, place, before = conv, True, 0, 0, None
                illegal = before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                inserted(back)
                place += 1
                move = back >> 2 * state & 3
                cost = DELETE if move == 0 else (REROLE if move == 3 else 0) + (TRUNCATED if kind & 4 else 0)
                if move == 3:
                    role = "user" if _NEXT[state] == 2 else "assistant"
                put(now, place, turn, role, text, _MOVES[move], fault, cost, illegal)
                if move:
                    state = _NEXT[state] if move == 3 else _KEPT[kind & 3][state]
                held += len(text) + 100
                if held > 1 << 24:
                    yield full()
            if held:
                yield full()
        if begun:
            inserted(_LAST[1])
            yield full()

    return edits


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with damage by the unsigned CRC-32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats the row, 4 sets the
    role user; other rows stay. Nulls of role and text, and of both ids in the hashed text, read
    as one space; turn keeps its null.
    """
    space = F.lit(" ")
    how = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "how")
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))).drop("_", "how")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with the first fault of each and the kind that the repair goes by."""
    space = F.lit(" ")
    dealt = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    blank = ~F.regexp_like("text", F.lit("[^\\x20\\x09-\\x0D]"))
    whole = F.regexp_like("text", F.lit("[.!?][\\x20\\x09-\\x0D]*\\z"))
    fault = F.when(blank, "blank").when(F.row_number().over(same) > 1, "duplicate").when(~whole, "truncated")
    marked = dealt.withColumn("fault", fault)
    initial = F.left("role", F.lit(1))
    own = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    gone = F.col("fault").isin("blank", "duplicate")
    return marked.withColumn("kind", F.when(gone, _MUST_GO).otherwise(own + F.when(F.col("fault") == "truncated", 4).otherwise(0)).cast("int"))


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of all conversations in rows (conv_id, turn, role, text), a row for each edit.

    Columns: conv_id; place, from 1 in the order of the edits; turn, null for an insertion; role
    and text as repaired; edit K, R, D or I (keep, rerole, delete, insert); fault of the row:
    blank, duplicate (role and text seen earlier), truncated or null; cost; illegal, whether the
    row's and the row's before it are not su, ua or au by initials. Rows that are not deleted, in
    order, are the repaired conversation. Rows come by turn, nulls first; equal turns by role and
    text. Null roles and texts read as one space; a null conv_id is a conversation of its own;
    other columns are not read; an empty table has no edits. The result is sorted by conversation
    and place within partitions, each of which holds whole conversations.
    """
    marked = _marked(rows)
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    last_first = marked.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), again.desc())
    back = last_first.mapInArrow(_backward, StructType([*marked.schema.fields]).add("back", "short"))
    first_first = back.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", again)
    out = StructType([marked.schema["conv_id"]]).add("place", "long").add(marked.schema["turn"])
    for name, kind in (("role", "string"), ("text", "string"), ("edit", "string"), ("fault", "string"), ("cost", "long"), ("illegal", "boolean")):
        out = out.add(name, kind)
    return first_first.mapInArrow(_forward(_arrow(out)), out)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations; place orders them. Conversations that vanish have no rows."""
    return edits(rows).where("edit <> 'D'").select("conv_id", "place", "role", "text")


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(schema: pa.Schema):
    """A conversation's report from its edits in order; memory is that of a batch and a letter for each edit."""

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        low = high = seen = None
        distinct = cost = illegal = 0
        faults, audit, text = {}, bytearray(), None

        def done() -> tuple:
            gaps = 0 if low is None else high - low + 1 - distinct
            return (now, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit.decode(), text.hexdigest())

        for batch in batches:
            made = []
            columns = [batch.column(c) for c in ("turn", "role", "text", "edit", "fault", "cost", "illegal")]
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                turn, role, words, edit, fault, price, wrong = (c[i].as_py() for c in columns)
                if not begun or conv != now:
                    if begun:
                        made.append(done())
                    now, begun, low, high, seen, distinct, cost, illegal, written = conv, True, None, None, None, 0, 0, 0, False
                    faults, audit, text = dict.fromkeys(("blank", "duplicate", "truncated"), 0), bytearray(), hashlib.sha256()
                if turn is not None and turn != seen:
                    low, high, seen, distinct = turn if low is None else low, turn, turn, distinct + 1
                if fault:
                    faults[fault] += 1
                cost, illegal = cost + price, illegal + wrong
                audit += edit.encode()
                if edit != "D":
                    text.update((b"\n" if written else b"") + f"{role}:{words}".encode())
                    written = True
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made) if made else [[]] * len(schema), schema)], schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(done(), schema)], schema=schema)

    return reports


def report(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): what was wrong, what the repair costs, and what it is.

    conv_id; gaps, turns that are missing between the first and the last (nulls passed over);
    blank, duplicate, truncated, rows by their first fault; illegal, neighbours whose roles do not
    follow one another; cost; audit, the edits' letters in order; repaired_sha256 of the repaired
    `role:text`, joined by newlines. convs (conv_id, each once) adds conversations without rows:
    zeros, an empty audit and the hash of an empty text. An empty table gives an empty one.
    """
    found = edits(rows)
    schema = StructType([found.schema["conv_id"]])
    for part in _REPORT.split(", "):
        schema = schema.add(*part.split(" "))
    out = found.mapInArrow(_reports(_arrow(schema)), schema)
    if convs is None:
        return out
    every = convs.select(F.col("conv_id").alias("_id")).join(out, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    empty: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.select(F.col("_id").alias("conv_id"), *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in schema.names[1:]))


def _sql_dp() -> str:
    """One step of the same programme in DuckDB: x holds the best rest of each state as a cost of nine digits and the edits."""
    add = lambda s, cost, letter: f"CASE WHEN {s} <> '' THEN lpad((left({s}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({s}, 10) END"
    cut = "(CASE WHEN y.k >= 4 THEN 5 ELSE 0 END)"

    def own(state: int) -> str:
        kept = " ".join(f"WHEN y.k % 4 = {kind} AND y.k < 8 THEN {add(f'x.s{to[state]}', cut, 'K')}" for kind, to in enumerate(_KEPT) if state in to)
        rerole = f"CASE WHEN y.k < 8 THEN {add(f'x.s{_NEXT[state]}', f'({cut} + 1)', 'R')} END"
        return f"least({add(f'x.s{state}', 2, 'D')}, CASE {kept} END, {rerole})"

    first = ", ".join(f"s{i}: {own(i)}" for i in range(4))
    # two insertions in a row are the most that can help
    two = lambda a, b: f"least({a}, {add(b, 5, 'I')})"
    three = lambda a: f"least({a}, {add('z.s2', 5, 'I')}, {add('(' + add('z.s3', 5, 'I') + ')', 5, 'I')})"
    second = f"s0: {three('z.s0')}, s1: {three('z.s1')}, s2: {two('z.s2', 'z.s3')}, s3: {two('z.s3', 'z.s2')}"
    return f"list_transform([{{{first}}}], lambda z: {{k: 0, {second}}})[1]"


#: The same in DuckDB: the programme over each conversation's list of kinds, from the last turn to the first.
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS how FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, how FROM c WHERE how <> 0),
d AS (SELECT conv_id, turn, role, text FROM r UNION ALL SELECT conv_id, turn, role, text FROM r WHERE how = 3),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM n),
k AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 8
    ELSE CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN fault = 'truncated' THEN 4 ELSE 0 END END AS kind,
    row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM f
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, coalesce(fault = 'duplicate', false))),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_concat([{{k: 0, s0: '000000000', s1: '000000010II', s2: '000000005I', s3: '000000000'}}],
      list({{k: kind, s0: '', s1: '', s2: '', s3: ''}} ORDER BY pos DESC)), lambda x, y: {_sql_dp()}).s0 AS best
    FROM k GROUP BY conv_id),
e AS (SELECT conv_id, j, substr(best, (9 + j)::BIGINT, 1) AS edit FROM g, generate_series(1, length(best) - 9) AS t(j)),
i AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS at, count(*) FILTER (edit <> 'D') OVER w AS nth FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
o AS (SELECT i.conv_id, i.j, i.edit, k.role, k.text, i.nth - max(CASE WHEN nth = 1 AND edit = 'K' AND left(k.role, 1) = 's' THEN 1 ELSE 0 END)
      OVER (PARTITION BY i.conv_id) AS nth
    FROM i LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM i.conv_id AND k.pos = i.at AND i.edit <> 'I'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text
    FROM o WHERE edit <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost,
  coalesce(substr(best, 10), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
