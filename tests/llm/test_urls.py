"""URL filters against brute force: links read by hand, components by search, decisions by definition."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urls

SCHEMA = "page_id long, url string, html string"
RULES = [("example.com", "/bad/", "block"), ("example.com", "/bad/fine", "allow"), ("net", "/", "allow"), ("evil.example", "/", "block")]


def link(href, quote='"'):
    return f"<html><head><LINK rel={quote}x canonical{quote}\n href={quote}{href}{quote}></head>"


PAGES = [
    (1, "https://a.org/x/y/z?q=1#top", link("../w/./v?r=2#s")), (2, "http://a.org/x/w/v?r=2", None), (3, "http://A.org:80/x/w/v?r=2#f", ""),
    (4, "https://b.org/1", link("//example.com/bad/1", "'")), (5, "https://b.org/2", "<meta http-equiv=Refresh content='5; URL=/1'>"),
    (6, "https://www.b.org/2/", "<!-- " + link("https://sub.net/") + " -->"), (7, "https://c.org/1", link("http://evil.example")), (8, "https://c.org/1?a&amp;b", link("/1")),
    (9, "https://c.org/2", link("http://x.net/ok")), (10, "https://c.org/2/", link("https://c.org/1")), (11, "https://example.com/bad/fineprint", "<link rel=canonical href=https://evil.example/a>"),
    (12, "http://d.org/q/", link("?page=2")), (13, "http://d.org/q/?page=2", link("#x")), (14, None, link("/z")), (15, "no url at all", link("/z")), (16, "", None), (17, "https://b.org/2", None), (17, "https://b.org/2", None),
    (18, "://h.org", "<link rel=canonical href>"), (19, "http://evil.example.org/", "<link rel='nocanonical' href='http://evil.example/'>"), (20, "http://notevil.example/", "<link " + "x" * 50_000), (21, "https://e.org/a", link("mailto:x@y")), (22, "https://e.org/b/..", link("../..")), (23, "https://e.org/", None),
]
REDIRECTS = [("https://far.org/1", "https://far.org/2"), ("https://far.org/2", "http://evil.example/z"), ("https://far.org/3", "https://far.org/1"), (None, "https://far.org/1"), ("https://f.org/", None)]
LINKS = {1: "../w/./v?r=2#s", 4: "//example.com/bad/1", 5: "/1", 7: "http://evil.example", 8: "/1", 9: "http://x.net/ok", 10: "https://c.org/1", 11: "https://evil.example/a", 12: "?page=2", 13: "#x", 21: "mailto:x@y", 22: "../.."}


def split(url):
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1].split("#")[0]
    before, _, query = rest.partition("?")
    host, slash, path = before.partition("/")
    return host.lower(), slash + path, ("?" + query) if "?" in rest else ""


def node(url):
    host, path, query = split(url)
    name, _, port = host.partition(":")
    return (name if port in ("80", "443", "") else host) + (path or "/") + query if host else None


def rule(url):
    host, path, _ = split(url)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=None)


def plain(n):
    n = n.removeprefix("www.")
    before, mark, query = n.partition("?")
    host, _, path = before.partition("/")
    return f"{host}/{path.rstrip('/')}{mark}{query}"


def brute(pages, redirects):
    pairs = [(u, urljoin(u, LINKS[i])) for i, u, _ in pages if i in LINKS] + list(redirects)
    everywhere = {u for p in pairs for u in p if u} | {u for _, u, _ in pages if u}
    near = {}
    for a, b in [(node(a), node(b)) for a, b in pairs] + [(node(u), plain(node(u))) for u in everywhere if node(u)]:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for i, u, _ in pages:
        own, seen, new = rule(u), {node(u)}, [node(u)]
        while new:
            for m in near.get(new.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    new.append(m)
        met = {rule(x)[2] for x in everywhere if node(x) and node(x) in seen and rule(x)}
        verdict = own[2] if own else "allow" if "allow" in met or not met else "block"
        out.append((i, *split(u)[:2], own[1] if own else None, verdict))
    return sorted(out, key=repr)


@pytest.mark.parametrize("redirects", [[], REDIRECTS])
def test_verdicts_by_brute_force(spark, redirects):
    pages = PAGES + [(30, "https://far.org/3/", None), (31, "https://www.far.org/2#x", None)]
    df = spark.createDataFrame(pages, SCHEMA).withColumns({c: F.lit(7) for c in ("node", "root", "rule", "a", "target", "v")})
    got = urls.judge_urls(df, RULES, redirects=spark.createDataFrame(redirects, "url string, target string") if redirects else None)
    assert got.columns == ["page_id", "url", "html", "node", "root", "a", "target", "v", "host", "path", "rule", "verdict", "reason"]
    found = sorted([tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()], key=repr)
    assert found == brute(pages, redirects)
    verdict = {r[0]: r[4] for r in found}
    assert verdict[5] == "block" and verdict[6] == "block" and verdict[7] == verdict[8] == "allow" and verdict[11] == "allow" and verdict[9] == "allow" and (verdict[30] == "block") == bool(redirects)


def test_links_are_resolved_as_browsers_do(spark):
    bases = ["http://h.org", "http://h.org/", "http://h.org/a", "http://h.org/a/", "http://h.org/a/b?x=/c/#/d"]
    links = ["x", "./x", "../x", "../../x/../y/", "/x/./y", "//k.org/z", "https://k.org/z?q#f", "?q", "#f", ".", "..", "x/..", "a:b", "x?y=../z"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in df.select("*", urls.node_of(urls.resolve(F.col("b"), F.col("x"))).alias("n")).collect():
        assert r["n"] == node(urljoin(r["b"], r["x"])), r


def test_a_class_of_thousands_and_no_pages(spark):
    """One canonical url of all pages, and a chain of redirects that leads to a block."""
    star = [(i, f"https://s.org/{i}", link("https://evil.example/")) for i in range(3000)] + [(9000 + i, f"https://t.org/{i}", link(f"/{i + 1}")) for i in range(60)] + [(9100, "https://t.org/60", link("http://example.com/bad/"))]
    got = urls.judge_urls(spark.createDataFrame(star, SCHEMA), RULES)
    assert {(r["verdict"], r["reason"]) for r in got.select("verdict", "reason").distinct().collect()} == {("block", "alias")}
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    with pytest.raises(ValueError):
        urls.match(F.lit("a"), F.lit("/"), RULES * 1000)
