from __future__ import annotations

from fringeflow.llm.url_filter import redirect_blocks

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def judge(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, alias string")
    return {r.page_id: r for r in redirect_blocks(pages, RULES, redirects).collect()}


def test_rules_hosts_and_paths(spark):
    urls = {
        1: ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        2: ("https://m.example.net/en/1?q#f", "m.example.net", "/en/1", "example.net/en/", "allow"),
        3: ("http://x.net", "x.net", "", None, "allow"),
        4: ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        5: ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        6: ("a.net/x", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("", "", "", None, "allow"),
        9: ("x://É.Net/#://b.org/fr/", "É.net", "/", "net/", "block"),
        10: ("http://org/fr/?x=/", "org", "/fr/", "org/fr/", "allow"),
        11: ("http://a.net?x/y", "a.net", "", None, "allow"),
    }
    got = judge(spark, [(i, u[0], None) for i, u in urls.items()])
    assert {i: (u[0], *[got[i][c] for c in ("host", "path", "rule", "verdict")]) for i, u in urls.items()} == urls


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    link = '<LINK rel="canonical" HREF="{}">'.format
    refresh = "<meta http-equiv=refresh content='0; url={}'>".format
    rows = [
        (1, "http://a.com/x", link("http://b.com/y")),
        (2, "http://b.com/y", refresh("https://c.org/z")),
        (3, "https://c.org/z", link("http://bad.net/")),
        (4, "http://b.org/fr/1", link("http://a.com/x")),
        (5, "http://www.a.com/x/", ""),
        (6, "http://d.com/", link("/e")),
        (7, "http://d.com/e", None),
        (8, "http://e.com/", "<a href='http://bad.net/'> canonical"),
    ]
    got = judge(spark, rows + [(9, "http://a.com/x", None)] * 2)
    assert {i: r.verdict for i, r in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"
    }
    assert got[1].propagated and not got[4].propagated


def test_known_redirects_and_empty_tables(spark):
    redirects = spark.createDataFrame([("http://q.com/1", "http://w.net/2"), (None, "http://w.net/2")], "src string, dst string")
    assert judge(spark, [(1, "http://q.com/1", None)], redirects)[1].verdict == "block"
    assert judge(spark, []) == {}


def test_only_canonical_links_and_refreshes_count_and_all_targets_resolve(spark):
    refresh = "<meta http-equiv=\"Refresh\" content=\"{}\">".format
    rows = [
        (1, "http://a.com/x", '<link rel="stylesheet" href="http://bad.net/refresh.css">'),
        (2, "http://a.com/y", '<meta name="canonical" content="url=http://bad.net/"><link rel=icon title="rel=canonical" href=http://bad.net/>'),
        (3, "http://b.com/p/q/r?s", refresh("0; url=next")), (4, "http://b.com/p/q/next", refresh("5;URL='../up?a=1&amp;b=2'")),
        (5, "http://b.com/p/up?a=1&b=2", '<link title="a > b" href="?page=2" rel="nofollow canonical">'),
        (6, "http://b.com/p/up?page=2", refresh("0, //c.com/./d/../e/")), (7, "http://c.com/e", "<link href=/../f rel=canonical />"),
        (8, "http://c.com/f", refresh("1; http://bad.net/")), (9, "http://d.com", refresh("0; url=g")), (10, "http://d.com/g", None),
        (11, "http://d.com/h?u=http://d.com/g", refresh("0; url=mailto:x@bad.net")), (12, "http://d.com/g/..", refresh("0; url=?u=http://bad.net/")),
    ]
    verdicts = {i: r.verdict for i, r in judge(spark, rows).items()}
    assert verdicts == {i: "block" if 3 <= i <= 8 else "allow" for i in range(1, 13)}
