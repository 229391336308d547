"""The pipeline against a brute-force version, stage by stage; queries with SQL against DuckDB."""

from __future__ import annotations

import collections
import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ravine.llm import decontaminate, entries, language_id
from tests.llm.test_links import smallest

D = "/root/testdata/sf0.001"


def brute_lines(docs):
    """docs {id: text} without repeated chunks of two lines or more."""
    cut = {}
    for i, text in docs.items():
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        ends = [k for k in range(len(h)) if (h[k] + 131071 * (h[k - 1] if k else 0) + 1048583 * (h[k - 2] if k > 1 else 0)) % 2147483647 % 4 == 0]
        starts = [0, *(k + 1 for k in ends if k + 1 < len(h))]
        cut[i] = ["\n".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(h)])]
    seen, out = set(), {}
    for i in sorted(cut):
        kept = []
        for c in cut[i]:
            if "\n" in c and c in seen:
                continue
            seen.add(c)
            kept.append(c)
        out[i] = "\n".join(kept)
    return out


def dirty_texts(texts, segments):
    """The ids of texts {id: text} that hold a segment with its budget of edits: alignments with all texts side by side."""
    ids, bodies = list(texts), [decontaminate.normal(t) for t in texts.values()]
    # a gap that no budget bridges belongs to the text before it
    body = np.frombuffer(b"".join(b + b"\0" * 64 for b in bodies), np.uint8)
    owner, steps = np.repeat(np.arange(len(ids)), [len(b) + 64 for b in bodies]), np.arange(len(body), dtype=np.int32)
    out = set()
    for s in {(s.data, s.budget): s for s in segments}.values():
        # row[p]: the fewest edits with which what is read of the segment ends before place p
        row = np.zeros(len(body), np.int32)
        for c in s.data:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (body[:-1] != c))
            row = np.minimum.accumulate(new - steps) + steps
        out |= {ids[k] for k in np.unique(owner[np.flatnonzero(row <= s.budget) - 1])}
    return out


def test_run_is_the_brute_force_version(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    told = language_id.predict(spark.read.parquet(f"{D}/documents.parquet"), language_id.fit(spark.read.parquet(f"{D}/documents.parquet")))
    texts = {r.doc_id: rows[r.doc_id].text for r in told.collect() if r.lang_pred != "und" and r.score >= 0.5}
    texts = brute_lines(texts)
    ids = sorted(texts)
    words = [texts[i].encode().lower().split() for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    texts = {i: texts[i] for i, c in zip(ids, smallest(len(ids), links, ids)) if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    dirty = dirty_texts(texts, [s for i, t in bench for s in decontaminate.segments(i, t, 0.1)])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert set(got) == set(texts) - dirty and dirty
    sizes = collections.Counter()
    for i, r in got.items():
        assert r.size == len(texts[i].encode().split()) and r.source == rows[i].source
        sizes[r.source] += r.size
    assert all(r.source_size == sizes[r.source] for r in got.values())


@pytest.mark.parametrize("name", entries.ORACLE_SQL)
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = con.execute(entries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = entries.QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
