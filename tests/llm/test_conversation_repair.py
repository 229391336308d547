"""Conversation repair against a search over all edits, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

from ravine.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(rows):
    """The cheapest edits of ordered rows (turn, role, text), by trying all: (cost, letters, lines), least first."""
    bad = faults(rows)

    @cache
    def best(i, initials):
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return None
        options = [(0, "", ())] if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials) else []
        steps = []
        if len(initials) < len(rows) * 2 + 3:
            steps = [(5, "I", i, x, f"{'user' if x == 'u' else 'assistant'}:") for x in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((2, "D", i + 1, "", None))
            if bad[i] not in ("blank", "duplicate"):
                cut = 5 if bad[i] else 0
                steps.append((cut, "K", i + 1, role[:1] or "-", f"{role}:{text}"))
                steps += [(cut + 1, "R", i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for cost, letter, at, initial, line in steps:
            rest = best(at, initials + initial)
            if rest:
                options.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(options) if options else None

    return best(0, "")


def wanted(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    bad = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = plain(rows)
    return (conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'own' as fault", "7 as kind", "8 as back")


def test_against_search(spark):
    rng, rows = random.Random(3), []
    for c in [*range(120), None]:
        for _ in range(rng.randrange(1, 6)):
            turn = rng.choice([None, *range(6)])
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "tool", "", "u2"]), rng.choice(["Yes.", "No", "What?", " ", "", "Go! \n", "cut"])))
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    got = {tuple(r) for r in cr.report(frame(spark, rows)).collect()}
    assert got == {wanted(c, r) for c, r in by.items()}
    texts = {}
    for r in cr.repaired(frame(spark, rows)).orderBy("conv_id", "place").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashes = {r[0]: r[-1] for r in got}
    for c in by:
        assert hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == hashes[c]


def test_null_texts_long_conversations_and_conversations_without_rows(spark):
    """A long conversation runs over several Arrow batches, and its repair is that of its parts."""
    n = 25_000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(n) if t % 5000 != 4999]
    rows += [(2, None, None, None), (3, 0, "user", "x" * 300_000 + "!"), (3, 1, "assistant", "ok.")]
    got = {r.conv_id: r for r in cr.report(frame(spark, rows), spark.range(1, 6).toDF("conv_id")).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    # each missing assistant's turn costs an insertion, the cheaper of deleting the user's turn before it is not: 2 < 5
    lost = n // 5000
    assert got[1].gaps == lost - 1 and got[1].cost == 2 * lost and got[1].audit.count("D") == lost
    assert (got[2].blank, got[2].cost, got[2].audit) == (1, 2, "D")
    assert (got[3].cost, got[3].audit) == (0, "KK")
    empty = hashlib.sha256(b"").hexdigest()
    assert all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", empty) for c in (4, 5))


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. B? C!") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    got = cr.damaged(frame(spark, rows)).collect()
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        one = (c, t, "user" if how == 4 else role, "" if how == 1 else "A B C" if how == 2 and text != " " else text)
        want += [one] * (0 if how == 0 else 2 if how == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty(spark):
    assert cr.report(frame(spark, [])).collect() == [] and cr.edits(frame(spark, [])).collect() == []
