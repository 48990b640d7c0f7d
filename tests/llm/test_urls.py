import random
import re

import duckdb

from lithograph.llm.urls import SQL, judge, resolved

C = '<link rel="canonical" href="{}">'
ROWS = [
    (1, "https://WWW.Example.com/en/a?x#y", "<p>"),
    (2, "http://m.example.com/en/b", None),
    (3, "http://x.net/es/b", ""),
    (4, "http://a.org/one", C.format("http://a.org/two")),
    (5, "http://a.org/two", '<META content="0; URL=http://b.net/fr/x" http-equiv=refresh>'),
    (6, "http://b.org/p", "<link href='/q' rel='canonical'>"),
    (7, "http://b.org/q#frag", C.format("//c.net/es/z")),
    (8, "http://b.org/r", C.format("http://d.com/") + C.format("http://b.org/q")),
    (9, None, C.format("http://c.net/es/z")),
    (10, "no scheme", None),
    (11, "http://net", None),
    (12, "http://q.com", None),
    (13, "http://a.org/one", None),
    (14, "x://y.org/a\nb?c", C.format("x://y.org/a")),
    (15, "ftp://example.com/en/", None),
    (16, "http://xnet/es/", None),
    (16, "http://xnet/es/", None),
    (20, "http://k.org/1", '<link rel="alternate  Canonical" href="http://e.net/es/z">'),
    (21, "http://k.org/2", '<base target=x><BASE href="//e.net/es/"><base href="http://d.com/"><link rel=canonical href=z>'),
    (22, "http://k.org/3", '<link rel=canonical data-href="http://d.com/" href = "http://e.net/es/z"/>'),
    (23, "http://k.org/4", "<link title='a > b' rel='canonical' href='http://e.net/es/z'>"),
    (24, "http://k.org/5", '<link title="rel=canonical href=http://e.net/es/z" rel=next href=/n>'),
    (25, "http://k.org/6", '<meta name=url content="0;url=http://e.net/es/z"><links rel=canonical href=http://e.net/es/z><link rel=canonical href>'),
    (26, "http://k.org/a/7", '<base href="../b/"><link rel=canonical href="../b/./8?x&amp;y">'),
    (27, "http://k.org/b/8?x&y", "<meta http-equiv=Refresh content=0;URL=http://e.net/es/z>"),
    (28, "http://k.org/9", "<link rel=canonical"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as id", "'q' as verdict", "'z' as source")
    rows = judge(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("m.example.com", "/en/b", "example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block")
    assert [got[i][2:] for i in (4, 5, 13)] == [(None, "block")] * 3  # an alias of a blocked page
    assert [got[i][2:] for i in (6, 7, 8)] == [(None, "allow")] * 3  # d.com is allowed, which comes first
    assert got[9] == got[10] == ("", "", None, "allow")
    assert got[11] == ("net", "", None, "allow") and got[12] == ("q.com", "", None, "allow")
    assert got[14][:2] == ("y.org", "/a\nb") and got[16][2:] == (None, "allow")
    assert [got[i][3] for i in (20, 21, 22, 23, 26, 27)] == ["block"] * 6 and [got[i][3] for i in (24, 25, 28)] == ["allow"] * 3
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    names = ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(map(str, r))
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({SQL})").fetchall(), key=key) == sorted((tuple(r[n] for n in names) for r in rows), key=key)
    assert judge(pages.limit(0)).count() == 0


def test_long_chain(spark):
    n = 40
    rows = [(i, f"http://h.org/{i}", C.format(f"http://h.org/{i + 1}")) for i in range(n)] + [(n, f"http://h.org/{n}", C.format("http://z.net/fr/"))]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in got} == {"block"}


def test_references_by_hand(spark):
    base = "http://a/b/c/d;p?q"  # RFC 3986, 5.4, and some more
    want = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
        "#s": "http://a/b/c/d;p?q#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
        "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
        "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "http://z/k/../l?u=/../": "http://z/l?u=/../",
        "g?u=http://x/y": "http://a/b/c/g?u=http://x/y", "mailto:x@y": None, "": None,
    }
    rows = spark.createDataFrame([(base, t) for t in want], "url string, t string")
    assert {r.t: r.target for r in rows.select("t", resolved(rows["url"], rows["t"]).alias("target")).collect()} == want
    bare = spark.createDataFrame([("http://a", "g"), ("no scheme", "g?u=http://x/")], "url string, t string")
    assert [r.target for r in bare.select(resolved(bare["url"], bare["t"]).alias("target")).collect()] == ["http://a/g", None]


def test_relative_and_broken_tags_join_their_component(spark):
    rows = [
        (1, "http://r.org/a/b", C.format("../x?id=3")),
        (2, "http://r.org/x?id=3", '<link\n  rel="canonical"\n  href="http://z.net/es/"\n>'),
        (3, "http://s.org/p", '<meta\nhttp-equiv="refresh"\ncontent="0; url=q.html">'),
        (4, "http://s.org/q.html", C.format("http://z.net/fr/")),
    ]
    assert {r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"block"}


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({SQL})").fetchall(), key=str)


def test_references_and_row_order_against_sql(spark):
    draw = random.Random(6)
    hosts = ["a.org", "b.org", "q.com", "z.net", "m.example.com", "www.example.com"]
    paths = ["", "/", "/es/", "/fr/x", "/en/p", "/p", "/p/q", "/p/./q", "/p?i=1&j=2"]
    refs = ["x", "./q", "../q", "/es/", "?i=1&amp;j=2", "//b.org/p", "#f", "", "../../fr/x", "q/..", "mailto:x@y", "HTTP://Z.net/es/", "http://q.com", "http://q.com/", "/p/./q?k=/../#t"]
    rows = []
    for i in range(150):
        tag = draw.choice(['<link rel="canonical" href="{}">', "<meta\nhttp-equiv=refresh\ncontent='0; url={}'>"])
        rows.append((i, f"http://{draw.choice(hosts)}{draw.choice(paths)}", draw.choice([None, "", tag.format(draw.choice(refs)), tag.format(draw.choice(refs)), tag.format(f"http://{draw.choice(hosts)}{draw.choice(paths)}")])))
    # forty small webs that don't meet
    apart = lambda i, x: re.sub(r"(?i)(//)(?=[a-z.]+\.(org|net|com))", rf"\g<1>w{i % 40}.", x or "")
    rows = [(i, apart(i, u), apart(i, h)) for i, u, h in rows]
    rows += [(200, "http://s.org/1", C.format("http://t.com")), (201, "http://s.org/2", C.format("http://t.com/"))]
    want = _sql(rows)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    for _ in range(3):
        got = judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert sorted((tuple(r[n] for n in ("page_id", "host", "path", "rule", "verdict")) for r in got), key=str) == want
        draw.shuffle(rows)


def test_very_long_url(spark):
    rows = [(1, "http://l.org/" + "a/" * 20_000, C.format("http://z.net/es/"))]
    assert judge(spark.createDataFrame(rows, "page_id long, url string, html string")).first().verdict == "block"


def test_open_tags_take_linear_time(spark):
    import time

    rows = [(1, "http://a.org/1", "<link " * 300_000), (2, "http://a.org/2", '<link href="' * 150_000), (3, "http://a.org/3", "<meta " + "a" * 1_000_000 + ">"), (4, "http://a.org/4", "<link rel=" + "=" * 500_000 + ">"), (5, "http://a.org/5", "<base a=' " * 200_000 + C.format("http://c.net/es/z"))]
    began = time.monotonic()
    assert len(judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == 5
    assert time.monotonic() - began < 60
