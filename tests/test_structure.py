"""Request chains, sitemap indexes, structured data, hosts and congestion on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pagelode.operators import hosts, request_chains, sitemaps, structured, vitals
from pagelode.operators import pages as pg


def test_longest_chains(spark):
    rows = [
        ("a", "doc", None), ("a", "css", "doc"), ("a", "font", "css"), ("a", "import", "css"), ("a", "image", "import"), ("a", "js", "doc"), ("a", "js", "font"),
        ("b", "x", "y"), ("b", "y", "x"), ("b", "z", "y"),
        ("c", "doc", None), ("c", "lost", "gone"), ("c", "self", "self"), ("c", "leaf", "lost"),
        ("e", "one", None),
    ] + [("d", f"n{k:03}", f"n{k - 1:03}" if k else None) for k in range(200)]
    requests = spark.createDataFrame(rows, "load_id string, node string, parent string")
    got = {r.load_id: (r.length, r.path) for r in request_chains.longest_chains(requests).collect()}
    assert got == {"a": (4, ["doc", "css", "import", "image"]), "c": (2, ["lost", "leaf"]), "d": (200, [f"n{k:03}" for k in range(200)]), "e": (1, ["one"])}
    depth = {(r.load_id, r.node): r.depth for r in request_chains.depths(request_chains.jumps(requests)).collect()}
    assert depth["a", "js"] == 2 and depth["d", "n199"] == 200 and ("b", "z") not in depth and ("c", "self") not in depth
    assert request_chains.longest_chains(requests.limit(0)).count() == 0


def test_chains_equal_a_recursive_version(spark):
    import random

    rng = random.Random(8)
    parents = {(k, n): (rng.randrange(60) if rng.random() < 0.93 else None) for k in range(20) for n in range(rng.randrange(1, 50))}
    requests = spark.createDataFrame([(k, n, p) for (k, n), p in parents.items()], "load_id int, node int, parent int")

    def way(load, node, seen=()):
        if node in seen:
            return None
        up = parents[load, node]
        if up is None or (load, up) not in parents:
            return [node]
        above = way(load, up, (*seen, node))
        return above and [*above, node]

    want = {}
    for load, node in parents:
        path = way(load, node)
        if path and (load not in want or (-len(path), node) < (-len(want[load]), want[load][-1])):
            want[load] = path
    assert {r.load_id: r.path for r in request_chains.longest_chains(requests).collect()} == want


ROOT, MID, LEAF, OTHER = "https://a.example/sitemap.xml", "https://a.example/mid.xml", "https://a.example/leaf.xml", "https://a.example/other.xml"
FILES = [
    (ROOT, f'<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc>{MID}</loc></sitemap><sitemap><loc> {OTHER} </loc><lastmod>2024-02-01</lastmod></sitemap><sitemap><loc>{ROOT}</loc></sitemap></sitemapindex>'),
    (MID, f"<sm:sitemapindex xmlns:sm='x'><sm:sitemap><sm:loc><![CDATA[{LEAF}]]></sm:loc></sm:sitemap><sm:sitemap><sm:loc>{ROOT}</sm:loc></sm:sitemap><sm:sitemap><sm:loc>https://a.example/gone.xml</sm:loc></sm:sitemap></sm:sitemapindex>"),
    (LEAF, "<urlset><url><image:image><image:loc>https://a.example/i.png</image:loc></image:image><loc>https://a.example/p?a=1&amp;b=2</loc><lastmod>2024-05-06T07:08:09Z</lastmod></url><url><loc>https://a.example/q/</loc><lastmod>soon</lastmod></url><url><loc></loc></url></urlset>"),
    (OTHER, "<urlset><url><loc>https://www.a.example/q</loc><lastmod>2999-01-01</lastmod></url></urlset>"),
    ("https://b.example/s.xml", "<html>not found</html>"),
]


def test_sitemap_indexes(spark):
    files = spark.createDataFrame(FILES, "url string, body string")
    roots = spark.createDataFrame([("a", ROOT), ("a", OTHER), ("b", "https://b.example/s.xml"), ("c", "https://c.example/none.xml")], "site string, url string")
    found = sitemaps.expanded(files, roots)
    got = {(r.site, r.sitemap): (r.level, r.is_index, r.entries) for r in found.collect()}
    assert got == {
        ("a", ROOT): (0, True, 3), ("a", OTHER): (0, False, 1), ("a", MID): (1, True, 3), ("a", LEAF): (2, False, 2), ("a", "https://a.example/gone.xml"): (2, None, 0),
        ("b", "https://b.example/s.xml"): (0, False, 0), ("c", "https://c.example/none.xml"): (0, None, 0),
    }
    listed = sitemaps.listed_pages(files, found)
    pages = {r.loc: (r.lastmod, r.sitemaps) for r in listed.collect()}
    assert pages == {"https://a.example/p?a=1&b=2": ("2024-05-06T07:08:09Z", 1), "https://a.example/q/": ("soon", 2)}
    assert [tuple(r) for r in sitemaps.lastmod_issues(listed, F.to_date(F.lit("2025-01-01"))).collect()] == [("a", 0, 1, 0, 2)]
    assert sitemaps.expanded(files, roots.limit(0)).count() == 0


def page(*scripts, body=""):
    return "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + body


PAGES = [
    (1, page('{"@type": "Article", "headline": " A  title ", "author": {"name": "N"}}', '{"@type": ["NewsArticle", "Thing"], "headline": "second"}')),
    (2, page('{"@graph": [{"@type": "WebPage"}, {"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": " Deep  one "}}, {"name": ""}]}]}]}')),
    (3, page('{"@type": "Article", oops}', '[{"@type": "Product", "headline": "of a list"}]')),
    (4, page(body='<nav aria-label="Breadcrumb"><ol><li><a href="/">Start</a></li><li>Here &amp; there</li></ol></nav>')),
    (5, page('"text"', "7", body='<ul class="x breadcrumbs"><li><b>One</b></li></ul>')),
    (6, None),
]


def test_structured_data(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, html string")
    found = structured.blocks(pages)
    assert {r.page_id: (r.blocks, r.errors) for r in structured.block_errors(found).collect()} == {1: (2, 0), 2: (1, 0), 3: (2, 1), 5: (2, 0)}
    objs = structured.objects(found)
    assert {r.page_id: r.types for r in structured.types(objs).collect()} == {1: ["article", "newsarticle", "thing"], 2: ["breadcrumblist", "webpage"], 3: ["product"]}
    assert {r.page_id: r.value for r in structured.field(objs, "article", "headline").collect()} == {1: "A title"}
    assert {r.page_id: r.value for r in structured.field(objs, "thing", "headline").collect()} == {1: "second"}
    crumbs = {r.page_id: (r.crumbs, r.source) for r in structured.breadcrumbs(pages, objs).collect()}
    assert crumbs == {2: (["Home", "Deep one"], "data"), 4: (["Start", "Here & there"], "html"), 5: (["One"], "html")}
    assert structured.types(structured.objects(found.limit(0))).count() == 0


@pytest.mark.parametrize("name, host, port, error", [
    ("example.com", "example.com", None, None), (" http://WWW.Example.COM/  ", "www.example.com", None, None), ("https://blog.example.co.uk:8443/articles?x#y", "blog.example.co.uk", 8443, None),
    ("bücher.de", "xn--bcher-kva.de", None, None), ("//example.com.", "example.com", None, None), ("ftp://example.com", None, None, "scheme"), ("user@example.com", None, None, "credentials"),
    ("10.0.0.1", None, None, "address"), ("[::1]", None, None, "address"), ("example.com:99999", None, None, "port"), ("localhost", None, None, "reserved"), ("my.test", None, None, "reserved"), ("com", None, None, "no domain"),
    ("a..com", None, None, "empty label"), ("a" * 64 + ".com", None, None, "long label"), ("-a.com", None, None, "characters"), ("a_b.com", None, None, "characters"), ("", None, None, "empty"), (None, None, None, "empty"), ("x" * 2049, None, None, "too long"),
    ("a b.com", None, None, "not a name"), (".".join(["abcdefgh"] * 30) + ".com", None, None, "not a name"),
])
def test_domain_input(spark, name, host, port, error):
    r = hosts.parsed_input(spark.createDataFrame([(name,)], "input string")).first()
    assert (r.host, r.port, r.error) == (host, port, error)


def test_registrable_domains(spark):
    cases = {
        "example.com": ("com", "example.com", None, False, True), "blog.example.co.uk": ("co.uk", "example.co.uk", "blog", False, True), "co.uk": ("co.uk", None, None, False, True),
        "a.b.me.github.io": ("github.io", "me.github.io", "a.b", True, True), "github.io": ("github.io", None, None, True, True), "x.foo.ck": ("foo.ck", "x.foo.ck", None, False, True), "foo.ck": ("foo.ck", None, None, False, True),
        "www.ck": ("ck", "www.ck", None, False, True), "a.www.ck": ("ck", "www.ck", "a", False, True), "shop.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp", "shop", False, True), "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp", None, False, True),
        "www.site.zz": ("zz", "site.zz", "www", False, False), "zz": ("zz", None, None, False, False),
    }
    names = spark.createDataFrame([(h,) for h in [*cases, "EXAMPLE.com", "", None]], "host string")
    got = hosts.registrable(names, hosts.suffix_rules(spark))
    assert {r.host: (r.suffix, r.domain, r.subdomain, r.private, r.known) for r in got.collect()} == cases


def test_congestion_by_buckets(spark):
    tasks = spark.createDataFrame([("a", k, float(s), 60.0) for k, s in enumerate([0, 999, 1000, 3000, 5400, 5401, 9000])] + [("b", 1, 3000.0, 70.0)], "load_id string, id int, start double, duration double")
    interactions = spark.createDataFrame([("a", 1, 3000.0, 400.0, True), ("a", 2, 9000.0, 400.0, True), ("a", 3, 0.0, 900.0, False), ("b", 4, 3000.0, 10.0, True)], "load_id string, id int, start double, latency double, responded boolean")
    got = vitals.congestion(tasks, interactions)
    assert [tuple(r) for r in got.collect()] == [("a", 1, 3, 180.0)]
    near = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in near and "NestedLoop" not in near and near.count("bucket") > 2


def test_titles_by_spelling_or_case_aside(spark):
    rows = spark.createDataFrame([("s", 1, "A b"), ("s", 2, "A b"), ("s", 3, "a b"), ("s", 4, "a b"), ("s", 5, "A B"), ("t", 6, "A b")], "site string, page_id long, title string")
    assert {tuple(r) for r in pg.duplicates_of(rows, "title").collect()} == {("s", "a b", 5, 1)}
    assert sorted(tuple(r) for r in pg.duplicates_of(rows, "title", spelled=True).collect()) == [("s", "a b", 2, 1), ("s", "a b", 2, 3)]


def test_scores_at_a_half(spark):
    """68.85 of 0.9 is 76.5; a sum of the fractions for 0.9 would give 77 or 76 by their order."""
    load = spark.createDataFrame([(2620.0, 595.0, 0.1, None)], "lcp double, inp double, cls double, ttfb double")
    assert vitals.performance(load).first().score == 76.0
