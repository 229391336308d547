"""Kneser-Ney scores and mixtures against plain counts, alignments against a full table."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from ravine.llm import decontaminate, lm_scoring, mixing

D = "/root/testdata/sf0.001"


def test_mixed_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert (lm_scoring.unmixed(lm_scoring.mixed(x)) == x).all()


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_PART", 1 << 12)
    docs = spark.read.parquet(f"{D}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 4 = 1 as held_out")
    model = lm_scoring.train(docs.where("not held_out"))
    got = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    rows, one, two = docs.collect(), collections.Counter(), collections.Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    for r in rows:
        if not r.held_out:
            one.update(tokens(r.text))
            two.update(zip([None, *tokens(r.text)], tokens(r.text)))
    n, v = sum(one.values()), len(one)
    total, kinds, before = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter()
    for (a, b), c in two.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1
        before[b] += 1
    d = lm_scoring._discounts(collections.Counter(min(c, 5) for c in two.values()))
    spread = collections.Counter(min(c, 5) for c in before.values())
    e = lm_scoring._discounts(spread)
    left = sum(e[min(c, 3) - 1] * m for c, m in spread.items()) / len(two)

    def lower(w):
        return max(before[w] - (0, *e)[min(before[w], 3)], 0) / len(two) + left / (v + 1)

    def p(a, w):
        if a not in total:
            return lower(w)
        c = two[a, w]
        return max(c - (0, *d)[min(c, 3)], 0) / total[a] + sum(d[k - 1] * m for k, m in kinds[a].items()) / total[a] * lower(w)

    assert math.isclose(sum(p("the", w) for w in one) + p("the", "never seen"), 1.0, rel_tol=1e-9)
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(w in one for w in t), n)
        assert math.isclose(g.base_score, sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(g.score, sum(math.log10(p(a, w)) for a, w in zip([None, *t], t)), rel_tol=1e-9)


def test_the_query_learns_from_its_fold_alone(spark):
    import zlib

    from ravine.llm.entries import op5_lm_scoring

    got = {r.doc_id: r for r in op5_lm_scoring(spark, D).collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    one = collections.Counter()
    for i, words in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update([*words, "end"])
    n, v = sum(one.values()), len(one)
    for i, words in texts.items():
        t, r = [*words, "end"], got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in one for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0


def test_a_lost_part_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    model = lm_scoring.train(docs, folder=f"file://{tmp_path}/model")
    assert lm_scoring.score(docs, model).count() == 20
    (tmp_path / "model" / "pair-key-0.npy").unlink()
    with pytest.raises(Exception, match="pair-key-0"):
        lm_scoring.score(docs, model).collect()
    model.delete()
    assert not (tmp_path / "model").exists()


def filled(sizes, budget):
    """Targets by sharing the excess again and again."""
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes)))
    full = set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        each = {s: 2 * sizes[s] if s in full else rest * weights[s] / sum(w for k, w in weights.items() if k not in full) for s in sizes}
        over = {s for s in sizes if s not in full and each[s] > 2 * sizes[s]}
        if not over:
            return each
        full |= over


def test_mixtures_meet_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(400)]
    rows += [(1000 + i, None, "empty") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = filled(dict(sizes), 1.5 * sum(sizes.values()))
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12) and r.source_size == sizes[r.source]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_banded_alignment_is_the_full_one():
    rng = random.Random(2)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for c in p:
            new = [row[0] + 1]
            for j, u in enumerate(t):
                new.append(min(row[j] + (c != u), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(500):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 25)))
        q = bytearray(p)
        for _ in range(rng.randint(0, 3)):
            k, o = rng.randrange(len(q)), rng.random()
            q[k : k + (o < 0.6)] = b"" if o < 0.3 else bytes([rng.choice(b"abc")])
        t = bytes(rng.choice(b"abc") for _ in range(5)) + bytes(q) + bytes(rng.choice(b"abc") for _ in range(5))
        piece, text = np.frombuffer(p, np.uint8)[None], np.frombuffer(t, np.uint8)
        edits, start, end = (int(x[0]) for x in decontaminate.banded_matches(piece, text, np.array([-len(p)]), len(t) + len(p), 4))
        w = least(p, t)
        assert edits == min(w, 5) and (w > 4 or w == least(p, t[start:end]))


def test_passages_with_edits_are_found_and_others_left():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(40)) for _ in range(30)]
    index = decontaminate.Index([s for i, t in enumerate(items) for s in decontaminate.segments(i, t, 0.1)])
    for k in range(60):
        body = [" ".join(word() for _ in range(80)) for _ in range(2)]
        clean = decontaminate.normal(" ".join(body))
        assert list(decontaminate.places([clean], index)) == []
        text = bytearray(items[k % 30].encode())
        for _ in range(len(text) // 25):
            text[rng.randrange(len(text))] = ord("z")
        dirty = decontaminate.normal(body[0] + "  " + text.decode().upper() + "\n" + body[1])
        found = list(decontaminate.places([clean, b"", dirty, clean], index))
        assert [f[:2] for f in found] == [(2, k % 30)] * len(found) and found
        assert found[0][2] - len(body[0]) <= 40 and sum(f[3] - f[2] for f in found) > 0.5 * len(text)
