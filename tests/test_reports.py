"""Reports, importance, efficiency and registrations on cases worked out by hand."""

import json

from pyspark.sql import functions as F

from pagelode.operators import classify, domains, profiles, reports, robots

COLUMNS = "category string, depth int, inlinks int, nav_linked boolean, footer_linked boolean, in_sitemap boolean, title string, word_count int, h1 string, h2_count int, canonical string, canonicalised boolean, params int, crumbs int, description string, og string"


def test_importance(spark):
    rows = [
        ("Home", 9, 0, None, None, None, None, 0, None, 0, None, None, 9, 0, None, None),
        # 18 + 14 + 20 + 10 + 10 + 11 + 5 + 5 + 4 + 5 + 4 + 10 + 12, over the limit
        ("Blog", 1, 10, True, True, True, "A good title", 400, "H", 2, "c", False, 0, 2, "d", "o"),
        # 6 + 6 + 8 + 0 + 5 + 5 + 5 + 0 + 0 + 3 + 0 + 4 + 4
        ("Other", 3, 2, False, True, False, "Title", 80, "H", 1, "", None, 1, 1, None, ""),
        # 3 + 2 + 0 + 0 + 0 + 1 + 0 + 0 + 0 + 0 + 0 + 0 - 40, under zero
        ("Tags", 7, None, None, None, None, "", None, "", None, None, True, 2, None, "", None),
    ]
    got = classify.importance(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.importance, r.band) for r in got] == [(100, "High"), (99, "High"), (46, "Low"), (0, "Low")]


def test_efficiency_and_full_score(spark):
    columns = "requests int, bytes double, static int, cacheable double, text int, compressed double, tasks int, nodes int, lcp double"
    rows = [(20, 400 * 1024.0, 10, 5.0, 4, 2.0, 2, 100, 2500.0), (70, 2400 * 1024.0, 0, 0.0, 0, 0.0, 4, 5001, 4000.0), (0, 1.0, None, None, None, None, None, None, 3250.0), (5, None, 4, 4.0, 0, 0.0, 30, 3000, None)]
    got = profiles.tool_score(profiles.efficiency(spark.createDataFrame(rows, columns))).collect()
    assert [(r.resource_part, r.network_part, r.rendering_part) for r in got] == [(100.0, 50.0, 100.0), (48.0, 60.0, 59.0), (None, None, None), (None, 60.0, 0.0)]
    assert [r.score for r in got] == [93.0, 27.0, 50.0, None]


def test_registrations(spark):
    card = lambda *rows: ["vcard", [["version", {}, "text", "4.0"], *[[k, {}, "text", v] for k, v in rows]]]
    rdap = {
        "events": [{"eventAction": "registration", "eventDate": "1995-08-14T04:00:00Z"}, {"eventAction": "last changed", "eventDate": "2024-08-14T07:01:34Z"}, {"eventAction": "Expiration", "eventDate": "2025-08-13T04:00:00Z"}],
        "status": ["client delete prohibited", "active"], "nameservers": [{"ldhName": "A.IANA-SERVERS.NET"}, {"unicodeName": "b.iana-servers.net"}, {"ldhName": ""}], "secureDNS": {"delegationSigned": True},
        "entities": [{"roles": ["registrant"], "vcardArray": card(("fn", "Nobody"))}, {"roles": ["Registrar", "abuse"], "vcardArray": card(("fn", ""), ("ORG", ["Names Ltd", "Unit"]))}],
    }
    whois = "Domain: x\r\nSponsoring Registrar: Other Inc \r\nRegistered on: 01-Jun-2015\r\nExpiry date: 2027-06-01\r\nstate: ok\r\nName Server: NS1.X.COM\r\nName Server: ns1.x.com\r\nDNSSEC: unsigned\r\n"
    rows = [("a", json.dumps(rdap), "Registrar: not this"), ("b", None, whois), ("c", None, None), ("d", json.dumps({"entities": []}), None)]
    got = {r.domain: tuple(str(x) if x is not None else None for x in r)[1:] for r in domains.registrations(spark.createDataFrame(rows, "domain string, rdap string, whois string")).collect()}
    assert got == {
        "a": ("rdap", "1995-08-14", "2024-08-14", "2025-08-13", "client delete prohibited,active", "Names Ltd", "a.iana-servers.net,b.iana-servers.net", "signed"),
        "b": ("whois", "2015-06-01", None, "2027-06-01", "ok", "Other Inc", "ns1.x.com", "unsigned"),
        "c": ("none", None, None, None, "", None, "", None), "d": ("rdap", None, None, None, "", None, "", None),
    }


def test_report_rows(spark):
    rows = [("s", "low", "seo", "/a", "Title", "Too short", 50), ("s", "critical", "links", "Site", "Broken", "9 links", 90), ("s", "low", "seo", "/b", "Title", "MISSING", 70), ("s", "info", "seo", "Site", "Note", "x", 10), ("s", "manual", "policy", "Site", "Check", "y", 20), ("t", "low", "seo", "/z", "T", "", 1)]
    found = spark.createDataFrame(rows, "site string, status string, category string, page string, name string, evidence string, confidence int")
    shown = lambda **k: [(r.site, r.rank, r.name, r.page) for r in reports.report_rows(found, **k).orderBy("site", "rank").collect()]
    assert shown() == [("s", 1, "Broken", "Site"), ("s", 2, "Title", "/b"), ("s", 3, "Title", "/a"), ("s", 4, "Note", "Site"), ("s", 5, "Check", "Site"), ("t", 1, "T", "/z")]
    assert shown(status="manual") == [("s", 1, "Note", "Site"), ("s", 2, "Check", "Site")] and shown(search="missing") == [("s", 1, "Title", "/b")]
    assert shown(category="seo", scope="page", search="title") == [("s", 1, "Title", "/b"), ("s", 2, "Title", "/a")] and shown(scope="site", status="critical") == [("s", 1, "Broken", "Site")]


def test_orders_and_files(spark):
    pages = spark.createDataFrame([("s", "docs", 1, None, 5), ("s", "docs", 2, 2, 1), ("s", "docs", 3, 1, 0), ("s", "docs", 4, None, 9), ("s", "docs", 5, 2, 8), ("s", "blog", 6, None, None)], "site string, section string, page_id int, user_order int, score int")
    got = {r.page_id: r.place for r in reports.user_ordered(pages).collect()}
    assert got == {3: 1, 5: 2, 2: 3, 4: 4, 1: 5, 6: 1}
    heavy = spark.createDataFrame([(39, 25_001, 8, 0), (39, 25_001, 7, 6), (40, 99_999, 9, 9), (0, 25_000, 9, 9), (0, 30_000, 7, 5)], "w int, n int, s int, i int")
    assert [r.x for r in heavy.select(reports.js_heavy(F.col("w"), F.col("n"), F.col("s"), F.col("i")).alias("x")).collect()] == [True, True, False, False, False]
    files = spark.createDataFrame([("a", 0, 10), ("a", 1, 99), ("b", 0, 50)], "site string, file_no long, bytes long")
    index = reports.sitemap_index(files).collect()
    assert [(r.site, r.body.count("<loc>"), r.body.index("sitemap-1") < r.body.index("sitemap-2")) for r in index] == [("a", 2, True)]
    assert [tuple(r) for r in reports.near_limit(files, 50).collect()] == [("a", 1, 99)]


def test_ai_access(spark):
    rules = spark.createDataFrame([("a", "*", "disallow", "/"), ("a", "gptbot", "allow", "/"), ("b", "*", "disallow", "/x"), ("b", "gptbot", "disallow", "/*"), ("b", "ccbot", "disallow", "/y")], "site string, agent string, type string, path string")
    sites, bots = spark.createDataFrame([("a",), ("b",), ("c",)], "site string"), spark.createDataFrame([("GPTBot",), ("CCBot",), ("YouBot",)], "token string")
    got = {(r.site, r.token): r.state for r in robots.ai_access(rules, sites, bots).collect()}
    assert got == {
        ("a", "GPTBot"): "mentioned", ("a", "CCBot"): "blocked", ("a", "YouBot"): "blocked", ("b", "GPTBot"): "blocked", ("b", "CCBot"): "mentioned", ("b", "YouBot"): "allowed",
        ("c", "GPTBot"): "allowed", ("c", "CCBot"): "allowed", ("c", "YouBot"): "allowed",
    }
