"""SimHash, embedding and paragraph groups, and components, against all pairs."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
import xxhash

from ravine.llm import buckets, components, embedding_dedup, simhash, substring_dedup
from ravine.llm.common import local_roots

D = "/root/testdata/sf0.001"


def smallest(n, links, ids):
    """The smallest id reachable from each of n things."""
    a, b = (np.array(x, int) for x in zip(*links)) if links else (np.empty(0, int),) * 2
    roots, best = local_roots(n, a, b), {}
    for r, i in zip(roots, ids):
        best[r] = min(best.get(r, i), i)
    return [best[r] for r in roots]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for l in links for x in l})
    at = {x: i for i, x in enumerate(nodes)}
    want = dict(zip(nodes, smallest(len(nodes), [(at[a], at[b]) for a, b in links], nodes)))
    assert got == {k: v for k, v in want.items() if any(k in l and l[0] != l[1] for l in links)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard", [1024, 8])
def test_fingerprint_groups(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(shard)
    values = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            values.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}))
    values = sorted(values)
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    signed = [v - (v >> 63 << 64) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = [tuple(r) for r in simhash.fingerprint_links(df).collect()]
    at = {v: i for i, v in enumerate(signed)}
    assert smallest(len(values), [(at[a], at[b]) for a, b in found], signed) == smallest(len(values), links, signed)
    assert {(max(at[a], at[b]), min(at[a], at[b])) for a, b in found} <= {(i, j) for i in range(len(values)) for j in range(i)}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = smallest(len(docs), links, [r.doc_id for r in docs])
    df = spark.createDataFrame(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, want)}


@pytest.mark.parametrize("block", [2048, 64])
def test_embedding_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for i in range(900):
        base = rng.normal(size=24) if i < 200 or rng.random() < 0.3 else np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=24) * rng.choice([0.0, 0.02, 0.04])
        rows.append((i, base.astype(np.float32).tolist(), int(rng.integers(3))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_components(df, cell_rows=100).collect()}
    x, label = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows])
    norms = np.linalg.norm(x, axis=1)
    near = (x @ x.T / np.outer(norms, norms) >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = smallest(len(rows), list(zip(*np.nonzero(near))), range(len(rows)))
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i)
    assert near.sum() > 100


@pytest.mark.parametrize("part", [1024, 4])
def test_paragraph_groups(spark, monkeypatch, part):
    monkeypatch.setattr(buckets, "MEMBERS", part)
    rng = random.Random(part)
    word = lambda: f"w{rng.randrange(5000)}"
    bases = [[word() for _ in range(rng.randint(25, 90))] for _ in range(40)]
    docs = []
    for i in range(200):
        lines = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p[rng.randrange(len(p))] = word()
            lines.append(" ".join(p))
        docs.append((i, "\n".join(lines)))
    found = [(d, n, w) for d, t in docs for n, w in substring_dedup.paragraphs(t, 25)]
    sets = [set(zip(*(w[k:] for k in range(5)))) for _, _, w in found]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    first = smallest(len(found), links, [(d, n) for d, n, _ in found])
    want = sorted((d, n, len(w), *f) for (d, n, w), f in zip(found, first) if (d, n) != f)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = substring_dedup.repeated_paragraphs(df).collect()
    inside = {r.doc_id for r in rows if r.start_word is not None}
    got = sorted((r.doc_id, r.paragraph, r.words, r.kept_doc_id, r.kept_paragraph) for r in rows if r.start_word is None)
    # banding finds a pair at the threshold with probability 0.998
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.98 * len(want)
    gone = collections.Counter(r[0] for r in got)
    kept = {r.doc_id: r.text for r in substring_dedup.remove_paragraphs(df).collect()}
    assert all(len(kept[d].split("\n")) == max(1, len(t.split("\n")) - gone[d]) for d, t in docs if d not in inside)


def text_of(docs):
    return {i: t.lower().split() for i, t in docs}


def marked(docs, rows):
    """Places of each document's words that go."""
    out = {i: set() for i, _ in docs}
    for r in rows:
        lines = [len(x.split()) for x in dict(docs)[r.doc_id].split("\n")]
        start = r.start_word if r.start_word is not None else sum(lines[: r.paragraph])
        out[r.doc_id] |= set(range(start, start + r.words))
    return out


def check_passages(docs, rows):
    """Every 50 words that are repeated in what the paragraphs leave lose some, and what goes stands in what stays."""
    text, lines = text_of(docs), marked(docs, [r for r in rows if r.start_word is None])
    gone = marked(docs, rows)
    seen, stays = {}, set()
    for i in sorted(text):
        for p in range(len(text[i]) - 49):
            if not lines[i] & set(range(p, p + 50)):
                first = seen.setdefault(tuple(text[i][p : p + 50]), (i, p))
                assert first == (i, p) or len(gone[i] & set(range(p, p + 50))) >= 32
    for i in text:
        stays |= {w for p, w in enumerate(text[i]) if p not in gone[i]}
    for i in text:
        assert all(text[i][p] in stays for p in gone[i] - lines[i])


def test_passages_inside_paragraphs(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [words(70) for _ in range(30)]
    docs = [(2 * i + j, " ".join([*words(100 + 30 * j), *p, *words(90)])) for i, p in enumerate(shared) for j in (0, 1)]
    docs += [(1000 + i, " ".join([*words(40), *shared[0][:13], *words(200)])) for i in range(5)]
    docs += [(2000, "\n".join(" ".join(shared[4][k : k + 9]) for k in range(0, 70, 9)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substring_dedup.repeated_paragraphs(df).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2 * i + 1, 2 * i) for i in range(30)} | {(2000, 8)}
    check_passages(docs, got)
    assert {(r.doc_id, r.words) for r in got} == {(2 * i + 1, 70) for i in range(30)} | {(2000, 70)}
    text = dict(docs)
    for r in substring_dedup.remove_paragraphs(df).collect():
        lost = sum(g.words for g in got if g.doc_id == r.doc_id)
        assert len(r.text.split()) == len(text[r.doc_id].split()) - lost


@pytest.mark.parametrize("seed", [1, 2])
def test_no_word_is_lost(spark, seed):
    rng = random.Random(seed)
    words = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    docs = []
    for k in range(0, 60, 6):
        one, two, three = words(60), words(60), words(200)
        changed = [*three[:100], *words(1), *three[101:]]
        docs += [(k, one), (k + 1, two), (k + 2, [*one, *words(6), *two]), (k + 3, changed), (k + 4, three), (k + 5, three[60:140])]
    docs += [(900, one + one), (901, [*two[:55], *three[:55], *two[5:]]), (None, one), (902, one), (902, one)]
    docs = [(i, " ".join(t)) for i, t in docs]
    rows = substring_dedup.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    text, gone = dict(docs), marked(docs, rows)
    for k in range(0, 60, 6):
        assert not gone[k + 2] & set(range(60, 66)) and not gone[k + 3]
        assert any(text[k + 4].split()[100] in {w for p, w in enumerate(text[i].split()) if p not in gone[i]} for i in (k + 4, k + 5))
    assert {r.kept_doc_id for r in rows if r.doc_id == 902} == {None}
