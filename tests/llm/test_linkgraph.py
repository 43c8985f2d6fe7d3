import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import linkgraph as lg
from ledgerlens.llm.queries import URL_RULES


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' AS host", "'clash' AS verdict", "'clash' AS src", "'clash' AS id")


def test_hosts_and_paths(spark):
    urls = {"http://A.Example.COM/X/y?q#f": ("a.example.com", "/X/y"), "x://h": ("h", ""), "://h/p#a?b": ("h", "/p"), "//h/p": ("", ""),
            "http://ÄB.net#x": ("Äb.net", ""), "http://h?u=http://k/z": ("h", ""), "a\nb://h/\nx": ("h", "/\nx"), None: ("", ""), "": ("", "")}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r[0]: (r[1], r[2]) for r in df.select("u", lg.host_of(F.col("u")), lg.path_of(F.col("u"))).collect()}
    assert got == urls


def test_rules(spark):
    cases = {"http://x.net/": ("net/", "block"), "http://net/a": ("net/", "block"), "http://y.io": (None, "allow"), "http://x.net": (None, "block"),
             "http://example.net/en/1": ("example.net/en/", "allow"), "http://a.example.net/en/": ("example.net/en/", "allow"),
             "http://notexample.net/en/": ("net/", "block"), "http://example.com/de/x": ("example.com/de/", "block"),
             "http://example.com/en/x": (None, "allow"), "http://q.org/fr/": ("org/fr/", "allow"), "http://q.org/fr": (None, "allow")}
    rows = lg.judge(pages(spark, [(i, u, None) for i, u in enumerate(cases)]), URL_RULES).collect()
    got = {r["id"]: (r["rule"], r["verdict"]) for r in rows}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def plain_rank(edges, seeds, rounds, d):
    total = sum(seeds.values())
    start = {h: s / total for h, s in seeds.items()}
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    mass = dict(start)
    for _ in range(rounds):
        new = {h: (1 - d) * s for h, s in start.items()}
        for (a, b), w in edges.items():
            if a in mass:
                new[b] = new.get(b, 0) + d * mass[a] * w / out[a]
        mass = new
    return mass


def test_propagation_as_brute_force(spark):
    link = '<a HREF = "{}">x</a>'.format
    html = {"http://good.org/fr/1": [link("http://friend.com/a"), link("//Friend.com/b")],
            "http://friend.com/": [link("https://far.io/z"), link("/own")],
            "http://spam.com/": [link("http://x.net/"), "<img src=//bad.net/i.png>"],
            "http://spam2.com/": [link("http://spam.com/")],
            "http://x.net/": [link("http://good.org/")], "http://bad.net/": [], "http://far.io/": [], "http://alone.io/": []}
    rows = [(i, u, "<html>" + "".join(x)) for i, (u, x) in enumerate(html.items())]
    got = {r["host"]: r for r in lg.judge(pages(spark, rows), URL_RULES, tolerance=1e-6).collect()}
    edges = {("good.org", "friend.com"): 1.0, ("friend.com", "far.io"): 1.0, ("spam.com", "x.net"): 1.0, ("spam.com", "bad.net"): 1.0,
             ("spam2.com", "spam.com"): 1.0, ("x.net", "good.org"): 1.0}
    trust = plain_rank(edges, {"good.org": 1.0}, 150, 0.85)
    distrust = plain_rank({(b, a): w for (a, b), w in edges.items()}, {"x.net": 1.0, "bad.net": 1.0}, 150, 0.85)
    for h, r in got.items():
        assert r["trust"] == pytest.approx(trust.get(h, 0.0), abs=1e-5) and r["distrust"] == pytest.approx(distrust.get(h, 0.0), abs=1e-5)
    assert {h: got[h]["verdict"] for h in ("friend.com", "far.io", "spam.com", "spam2.com", "alone.io")} == {
        "friend.com": "allow", "far.io": "allow", "spam.com": "block", "spam2.com": "block", "alone.io": "allow"}


def test_a_chain_is_followed_to_its_end(spark):
    """A host far behind its only seed is reached, whatever the number of rounds that takes."""
    rows = [(0, "http://h0.com/", None)] + [(i, f"http://h{i}.com/", f'<a href="http://h{i - 1}.com/">') for i in range(1, 40)] + [(40, "http://x.net/", None), (41, "http://h0.com/b", '<a href="//x.net">')]
    got = {r["host"]: r for r in lg.judge(pages(spark, rows), URL_RULES).collect()}
    assert got["h39.com"]["distrust"] > 0 and got["h39.com"]["verdict"] == "block"


def test_seeds_count_pages_whatever_the_path_of_their_rule(spark):
    rows = [(0, "http://example.com/de/1", None), (1, "http://example.com/de/2", None), (2, "http://fan.io/", '<a href="http://example.com/de/1">'),
            (3, "http://a.org/fr/", '<a href="http://b.io/">'), (4, "http://b.io/", None)]
    got = {r["host"]: r for r in lg.judge(pages(spark, rows), URL_RULES).collect()}
    assert got["fan.io"]["verdict"] == "block" and got["b.io"]["verdict"] == "allow"


def test_parent_names(spark):
    """Subdomains pass trust and distrust on through their common name."""
    rows = [(0, "http://a.shop.org/fr/", None), (1, "http://b.shop.org/", None), (2, "http://c.other.org/", None)]
    got = {r["host"]: r for r in lg.judge(pages(spark, rows), URL_RULES).collect()}
    assert got["b.shop.org"]["trust"] > 0 and got["c.other.org"]["trust"] == 0


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no host", ""), (1, "no host", ""), (2, "http://x.net/", None), (3, "http:///p", "<a href=//>")]
    got = lg.judge(pages(spark, rows), URL_RULES).collect()
    assert len(got) == 5 and all(r["verdict"] in ("allow", "block") for r in got)
    assert lg.judge(pages(spark, []), URL_RULES).count() == 0
    assert lg.judge(pages(spark, rows), []).where("verdict = 'block'").count() == 0
