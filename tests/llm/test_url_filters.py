"""URL filters: rules, aliases and classes against a plain union of addresses."""

from __future__ import annotations

import random
import re

import pytest

from ravine.llm import url_filters as uf

NO = "<html><head></head></html>"


def canonical(u):
    return f'<head><LINK href="{u}" rel="nofollow Canonical"></head>'


def refresh(u):
    return f"<meta http-equiv='refresh' content='0; URL={u}'>"


PAGES = [
    (1, "https://a.org/x", canonical("https://b.net/es/y")),  # an alias of a blocked address
    (2, "http://a.org/x/?utm_source=z#top", NO),  # the same address as 1
    (3, "https://c.org/1", canonical("/2")),
    (4, "https://c.org/2", refresh("https://d.net/fr/9")),  # a chain: 3 to 4 to a blocked address without a page
    (5, "https://e.org/", canonical("https://f.net/es/1")),
    (6, "https://e.org", canonical("https://ok.com/1")),  # an explicit allow in the class of 5 comes first
    (7, "https://www.example.com/en/1", canonical("https://example.com/en/1")),  # each keeps its own rule
    (8, "https://example.com/en/1", NO),
    (9, "https://q.net/es", NO),
    (10, "https://q.net/es/", NO),  # closing slash: 9 shares the block
    (11, None, canonical("https://b.net/es/y")),
    (12, "no address", None),
    (13, "HTTP://WWW.Example.COM:80/en/?q", NO),
    (14, "https://a.org/x", NO),
    (14, "https://a.org/x", NO),
    (15, "https://notexample.com/en/1", None),
    (16, "x://" + "a." * 5000 + "net/es/" + "b" * 20000, ""),
    (17, "https://net?/es/", NO),
]
WANT = {
    1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"),
    7: ("www.example.com/en/", "allow"), 8: ("example.com/en/", "block"), 9: (None, "block"), 10: ("net/es/", "block"), 11: (None, "allow"),
    12: (None, "allow"), 13: (None, "allow"), 14: (None, "block"), 15: ("com/", "allow"), 16: ("net/es/", "block"), 17: (None, "allow"),
}


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as alias", "7 as _url", "'x' as host", "'own' as `class`")


def test_verdicts(spark):
    got = uf.judge(frame(spark)).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.rule, r.verdict) for r in got} == WANT
    assert {(r.alias, r._url, r["class"]) for r in got} == {("own", 7, "own")}
    assert {r.page_id: (r.host, r.path) for r in got}[13] == ("www.example.com:80", "/en/")
    kept = uf.allowed(frame(spark))
    assert sorted(r.page_id for r in kept.collect()) == sorted(i for i, _, _ in PAGES if WANT[i][1] == "allow") and kept.columns == frame(spark).columns


def test_redirect_table_and_empty(spark):
    links = spark.createDataFrame([("https://z.org/a", "https://z.org/b"), ("https://z.org/b", "https://z.net/fr/1"), (None, "x://y")], "src string, dst string")
    rows = spark.createDataFrame([(1, "https://z.org/a", None)], "page_id long, url string, html string")
    assert uf.judge(rows, redirects=links).first().verdict == "block"
    assert uf.judge(rows, rules=()).first().verdict == "allow"
    assert uf.judge(frame(spark, [])).collect() == []


def test_against_plain_union(spark):
    rng = random.Random(5)
    hosts = ["a.org", "b.org", "x.net", "www.example.com", "example.com", "c.com", "d.io"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(12)}{rng.choice(['', '/', '#x'])}"
    rows = [(i, url(), rng.choice([NO, NO, canonical(url()), refresh(url())])) for i in range(300)]

    def parts(u):
        return re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u).groups()

    def rule(u):
        h, p = parts(u)
        fits = [(len(rh + rp), a) for a, rh, rp in uf.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(fits)[1] if fits else None

    key = lambda u: "".join(parts(u)).rstrip("/")
    parent, nodes = {}, set()

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, u, h in rows:
        nodes.add(u)
        for t in re.findall(r"(?:href=\"|URL=)([^\"']+)", h):
            nodes.add(t)
            parent[root(key(u))] = root(key(t))
    said = {}
    for u in nodes:
        said.setdefault(root(key(u)), set()).add(rule(u))
    want = {i: rule(u) or ("block" if "block" in said[root(key(u))] and "allow" not in said[root(key(u))] else "allow") for i, u, _ in rows}
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and set(want.values()) == {"allow", "block"}
    assert any(rule(u) is None and want[i] == "block" for i, u, _ in rows)


@pytest.mark.parametrize("tag,target", [("<link rel=canonical href=/a/b>", "https://h.org/a/b"), ("<link rel='canonical' href='//k.org/'>", "https://k.org/"), ("<link rel=\"canonical\" href=\"z\">", "https://h.org/p/z"), ("<link rel=stylesheet href=/c>", None)])
def test_links(spark, tag, target):
    got = uf.page_links(spark.createDataFrame([("https://h.org/p/q?x#y", tag)], "url string, html string")).collect()
    assert [r.dst for r in got] == ([target] if target else [])
