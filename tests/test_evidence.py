"""Technologies, important pages, the feed cascade, return links, requirements and bundles on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pagelode.operators import site_evidence as se
from pagelode.operators import technology as te


def test_technologies(spark):
    meta = lambda c: f'<meta name="generator" content="{c}">'
    rows = [
        (1, f"<html>{meta('WordPress 6.4')}<link href='/wp-content/a.css'>", {}, "", {"/wp-json/": 200}),  # 3 + 3 + 2
        (2, "<script src='/wp-includes/x.js'></script>", {"X-Pingback": "https://a/xmlrpc.php"}, "", {"/wp-json/": 404}),  # 3; the header's value isn't its own name
        (3, "<div id='__next'></div><script id=__NEXT_DATA__>", {"Server": "nginx/1.2", "CF-Ray": "x"}, "laravel_session=1", {}),
        (4, "wordpress is only talked about; com_content", {"server": "mynginx"}, "", {}),
        (5, None, None, None, None),
        (6, "<b data-v-0a1b2c3d>", {"x-vercel-cache": "HIT"}, "", {}),
    ]
    pages = spark.createDataFrame(rows, "page_id int, html string, headers map<string, string>, cookies string, paths map<string, int>")
    got = {(r.page_id, r.technology): (r.score, r.confidence, r.status) for r in te.detected(pages).collect()}
    assert got == {
        (1, "WordPress"): (8.0, 96, "detected"), (2, "WordPress"): (3.0, 76, "detected"), (3, "Next.js (React)"): (5.0, 96, "detected"), (3, "Nginx"): (3.0, 76, "detected"),
        (3, "Cloudflare"): (3.0, 76, "detected"), (3, "Laravel (PHP)"): (3.0, 76, "detected"),
    }
    plan = te.detected(pages)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_literals_that_begin_or_overlap(spark):
    df = spark.createDataFrame([("abcde",), ("xbcdx ABC",), (None,)], "t string")
    got = [r.x and sorted(r.x) for r in df.select(te.held_literals(F.col("t"), ["abc", "bcd", "abcde", "de", "zz"]).alias("x")).collect()]
    assert got == [["abc", "abcde", "bcd", "de"], ["abc", "bcd"], None]


PAGES = [
    ("a", 1, "k1", "/", "Home", "", "all about privacy"), ("a", 2, "k2", "/about-us", "About the team", "", ""), ("a", 3, "k3", "/p", "Imprint", "", "see our terms and conditions"),
    ("a", 4, "k4", "/contact", "Get in touch", "", "contact"), ("b", 5, "k5", "/x", "Nothing", "", ""), ("b", 6, "k6", "/y", "Nothing", "", "cookies"),
]
LINKS = [("a", 1, "k3", "Legal terms", True, True), ("a", 2, "k4", "Contact", True, False), ("a", 4, "k4", "Support", True, False), ("b", 6, "k5", "Privacy", True, False), ("b", 5, "k9", "Privacy", False, False), ("b", 5, "k6", "", True, True)]


def test_important_pages(spark):
    pages = spark.createDataFrame(PAGES, "site string, page_id int, key string, path string, title string, h1 string, visible_text string")
    links = spark.createDataFrame(LINKS, "site string, page_id int, key string, text string, internal boolean, nav boolean")
    got = {(r.site, r.role): (r.page_id, r.score, r.confidence, r.inlinks, r.linked) for r in se.important_pages(pages, links).collect()}
    assert got == {
        ("a", "about"): (2, 8, 99, 0, False),  # about and team in the address and title
        ("a", "terms"): (3, 8, 99, 1, True),  # two words of the text, two of an anchor from the home page
        ("a", "contact"): (4, 14, 99, 2, True),  # contact, in touch; one pattern of each of two anchors
        ("b", "privacy"): (5, 3, 72, 1, False),  # an anchor alone
    }
    signals = {(r.site, r.key): (r.inlinks, r.sources, r.nav_linked, r.nav_labels) for r in se.inlink_signals(links).collect()}
    assert signals == {("a", "k3"): (1, 1, True, ["legal terms"]), ("a", "k4"): (2, 2, False, []), ("b", "k5"): (1, 1, False, []), ("b", "k6"): (1, 1, True, [])}


def test_feed_cascade(spark):
    rows = [
        (1, True, 0, None, "", None, False), (2, False, 0, "X", "", None, False), (3, False, 403, "X", "", None, False), (4, False, 404, None, "", "t", True), (5, False, 301, None, "", "t", True),
        (6, False, 200, None, "application/pdf", "t", True), (7, False, 200, None, "text/html; charset=x", None, True), (8, False, 200, None, "", "t", False), (9, False, 200, None, "TEXT/HTML", "t", True), (10, None, None, None, None, "t", None),
    ]
    pages = spark.createDataFrame([("s", *r) for r in rows], "site string, page_id int, blocked boolean, status int, wall string, content_type string, title string, feedable boolean")
    judged = se.feed_cascade(pages)
    assert {r.page_id: r.reason for r in judged.collect()} == {1: "Robots", 2: "Unreachable", 3: "Bot protection", 4: "Broken", 5: "Redirect", 6: "Not HTML", 7: "No metadata", 8: "Not content", 9: None, 10: None}
    assert [(r.step, r.left_out, r.reached) for r in se.cascade_counts(judged).orderBy("step").collect()] == [(k, 1, 11 - k) for k in range(1, 9)]


def test_return_links(spark):
    rows = [("en", "en", "en"), ("en", "fr", "fr"), ("fr", "en", "en"), ("fr", "de", "de"), ("de", "de", "de"), ("es", "gone", "pt"), ("es", "en", "en"), ("solo", "solo", "en")]
    alternates = spark.createDataFrame([(a, lang, b) for a, b, lang in rows], "url_key string, lang string, href_key string")
    states = {(r.url_key, r.href_key): r.state for r in se.return_links(alternates).collect()}
    assert states == {("en", "en"): "self", ("en", "fr"): "returned", ("fr", "en"): "returned", ("fr", "de"): "one_way", ("de", "de"): "self", ("es", "gone"): "unknown", ("es", "en"): "one_way", ("solo", "solo"): "self"}
    assert [tuple(r) for r in se.language_clusters(alternates).collect()] == [("de", 5, 4, 5, 15)]


FACTS = "site string, pages long, with_scripts long, language string, supported boolean, site_type string, content_pages long, longest long, useful_pct double, thin_pct double, duplicates long, duplicate_pct double, ads_present boolean"


def test_requirements(spark):
    rows = [
        ("good", 10, 5, "en", True, "blog", 8, 900, 80.0, 5.0, 0, 0.0, True), ("bad", 10, 1, "xx", False, "ecommerce", 3, 300, 20.0, 70.0, 5, 50.0, False),
        ("tool", 3, 0, None, None, "tools", 1, 90, 0.0, 0.0, 1, 30.0, None), ("thin", 4, 4, "en", True, "business", 1, 100, None, None, 0, 0.0, True),
    ]
    found = se.requirement_findings(spark.createDataFrame(rows, FACTS))
    got = {}
    for r in found.collect():
        got.setdefault(r.site, {})[r.requirement] = r.level
    hand = "reseller lines"
    assert got == {
        "good": {"scripts": "passed", "language": "passed", "site type": "passed", "original content": "passed", "ads.txt": "passed", hand: "manual"},
        "bad": {"scripts": "low", "language": "high", "site type": "high", "original content": "high", "no generated content": "high", "ads.txt": "low", hand: "manual"},
        "tool": {"scripts": "low", "language": "manual", "site type": "passed", "no generated content": "medium", "ads.txt": "low", hand: "manual"},
        "thin": {"scripts": "passed", "language": "passed", "site type": "medium", "original content": "medium", "ads.txt": "passed", hand: "manual"},
    }
    states = {(r.site, r.need): r.state for r in se.requirement_states(found).collect()}
    assert states == {
        ("good", "content"): "met", ("good", "integration"): "manual", ("good", "audience"): "met", ("bad", "content"): "not met", ("bad", "integration"): "manual", ("bad", "audience"): "not met",
        ("tool", "content"): "not met", ("tool", "integration"): "manual", ("tool", "audience"): "manual", ("thin", "content"): "not met", ("thin", "integration"): "manual", ("thin", "audience"): "met",
    }
    files = spark.createDataFrame([("a", "# x\nnet.example, 1, DIRECT\r\n\nother.example, 2"), ("b", " "), ("c", None)], "site string, body string")
    assert {tuple(r) for r in se.ads_txt(files, "Net.example").collect()} == {("a", True, 2, True), ("b", False, 0, False), ("c", False, 0, False)}


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"meta": None}, "no metadata"), ({"meta": {"transport": "server-proxy"}}, "no address"), ({"meta": {"finalUrl": "u", "transport": "carrier pigeon"}}, "unknown transport"), ({"vitals": 5}, "no vitals"),
    ({"resources": {}}, "resources is no list"), ({"fonts": None}, None), ({"loafs": "x"}, "loafs is no list"),
])
def test_bundles(spark, change, error):
    bundle = {"meta": {"requestedUrl": " https://a.example/\u0001x ", "transport": "server-proxy"}, "vitals": {"lcp": 2500, "inp": "180", "cls": 0.1}, "resources": [1, 2]} | change
    read = se.bundles(spark.createDataFrame([(1, json.dumps(bundle))], "key int, value string"))
    assert [r.error for r in read.collect()] == [error] and se.quarantined(read).count() == (error is not None)
    if not change:
        assert [tuple(r) for r in se.accepted(read).collect()] == [(1, "https://a.example/ x", "server-proxy", 2500.0, None, 0.1, None, 2)]


def test_lines_that_are_no_bundles(spark):
    read = se.bundles(spark.createDataFrame([(1, "{oops"), (2, None), (3, "[1]"), (4, "")], "key int, value string"))
    assert {r.key: r.error for r in read.collect()} == {1: "not JSON", 2: "not JSON", 3: "missing bundle", 4: "not JSON"}
    pages = spark.createDataFrame([("https://a.example/", "<p>x"), ("ftp://a", "<p>"), (None, "<p>"), ("http://b/", " "), ("http://b/", None), ("http://b/", "text")], "url string, html string")
    assert [r.error for r in se.page_errors(pages).collect()] == [None, "bad address", "bad address", "no body", "no body", "no markup"]


def test_ads_txt_lines_of_one_digit(spark):
    files = spark.createDataFrame([("a", "0\n1\n # 2\n")], "site string, body string")
    assert [tuple(r) for r in se.ads_txt(files, "x").collect()] == [("a", True, 2, False)]


def test_clusters_of_pages_that_share_an_address(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from pagelode.plans import evidence_queries as eq

    one, two = "https://a.example/en/1", "https://www.a.example/de/2"
    rows = list(enumerate([one, one, two, "https://a.example/fr/3", two, "https://b.example/en/", "https://b.example/en/", "https://c.example/en/", None, None], 1))
    spark.createDataFrame([(k, url, "<p>") for k, url in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {tuple(r) for r in eq.language_clusters(spark, str(tmp_path)).select("cluster", "pages", "languages", "links", "holes").collect()}
    want = set(con.execute(f"SELECT cluster, pages, languages, links, holes FROM ({eq.ORACLES['language_clusters']})").fetchall())
    assert got == want and ("https://b.example/en/", 2, 1, 0, 2) in got and any(r[0] == one and r[1] == 5 for r in got)
