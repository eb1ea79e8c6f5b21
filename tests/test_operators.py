"""Operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.functions import urls
from pagelode.operators import audits as au
from pagelode.operators import categories as ca
from pagelode.operators import domains, links, neardup, pages, profiles, robots, vitals
from pagelode.operators import outputs as out
from pagelode.operators import seo_audit as seo
from pagelode.streaming import events as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Www.A.com:443//b//c/?utm_source=x&k=1&k=1&ref=2#top", "https://www.a.com/b/c?k=1"),
        ("http://a.com", "http://a.com/"),
        ("http://a.com:8080/x", "http://a.com:8080/x"),
        ("ftp://a.com/x", None),
        ("not a url", None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.lit(url))) == want


def test_internal_and_resolve(spark):
    assert one(spark, urls.is_internal(F.lit("https://www.a.com/x"), F.lit("http://a.com")))
    assert one(spark, urls.is_internal(F.lit("https://b.a.com/x"), F.lit("http://a.com"), True))
    assert not one(spark, urls.is_internal(F.lit("https://ba.com/x"), F.lit("http://a.com"), True))
    for href, want in {"/y": "https://a.com/y", "//c.com/z": "https://c.com/z", "?q=1": "https://a.com/p/x?q=1", "n": "https://a.com/p/n", "http://d.com/": "http://d.com/"}.items():
        assert one(spark, urls.resolve(F.lit(href), F.lit("https://a.com/p/x"))) == want


def test_text(spark):
    html = "<html><body><nav>menu</nav><!-- no --><script>var x='<p>';</script><article><p>It&#39;s &amp; more.</p></article></body></html>"
    assert one(spark, tx.visible(F.lit(html))) == "menu It's & more."
    assert one(spark, tx.main_text(F.lit(html))) == "It's & more."
    assert one(spark, tx.words(F.lit("don't ' stop-now 42"))) == ["don't", "stop", "now", "42"]
    assert [one(spark, tx.syllables(F.lit(w))) for w in ("the", "table", "readability", "jumped", "éé")] == [1, 2, 5, 1, 0]
    assert one(spark, tx.half_up(F.lit(-2.5))) == -2.0


def test_robots(spark):
    body = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow: /x\nAllow: /x\nDisallow:\n"
    rules = robots.parse_robots(spark.createDataFrame([("s", body), ("t", "Disallow: /lost\n"), ("u", "")], "site string, body string"))
    assert rules.where("agent = 'gptbot'").count() == 2 and rules.where("site = 't'").count() == 0
    bots = spark.createDataFrame([("GPTBot",), ("bingbot",)], "token string")
    paths = spark.createDataFrame([("s", p) for p in ("/a/c", "/a/b/c", "/f.pdf", "/f.pdfx", "/x")] + [("t", "/")], "site string, path string")
    got = {(r.site, r.path, r.token): r.verdict for r in robots.verdicts(rules, paths, bots).collect()}
    assert got["s", "/a/c", "GPTBot"] == "blocked" and got["s", "/a/b/c", "GPTBot"] == "allowed"
    assert got["s", "/f.pdf", "bingbot"] == "blocked" and got["s", "/f.pdfx", "bingbot"] == "allowed" and got["s", "/f.pdf", "GPTBot"] == "allowed"
    assert got["s", "/x", "bingbot"] == "allowed" and got["t", "/", "bingbot"] == "uncertain"


def test_agent_tokens(spark):
    log = spark.createDataFrame([("x GPTBot/1",), ("xGPTBot",), ("gptbot",), ("GPTBot CCBot",)], "ua string")
    assert [(r.bots, r.token) for r in robots.match_agents(log, ["GPTBot", "CCBot"]).collect()] == [(1, "GPTBot"), (0, None), (0, None), (2, None)]


def test_depth_on_a_cycle_and_a_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    depth = links.click_depth(edges, spark.createDataFrame([(1,)], "page_id long"))
    assert sorted(map(tuple, depth.collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_depth_beyond_sixty_four(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "src long, dst long").coalesce(1)
    homes = spark.createDataFrame([(0,)], "page_id long").coalesce(1)
    assert {r.page_id: r.depth for r in links.click_depth(edges, homes).collect()} == {k: k for k in range(67)}


def test_clusters_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.cluster) for r in neardup.clusters(pairs).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_clusters_of_a_chain_in_any_order(spark, monkeypatch):
    import random

    names = [f"n{k:04}" for k in range(3000)]
    random.Random(5).shuffle(names)
    pairs = spark.createDataFrame([*zip(names, names[1:]), ("x", "x"), ("y", None)], "a string, b string")
    rounds, kept = [], neardup.stored

    def counted(df):
        rounds.append(1)
        assert len(rounds) < 20
        return kept(df)

    for name in ("stored", "checkpoint"):
        monkeypatch.setattr(neardup, name, counted, raising=False)
    assert {(r.node, r.cluster) for r in neardup.clusters(pairs).collect()} == {(n, "n0000") for n in names} | {("x", "x")}


def test_texts_are_split_once_and_html_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, "s", "https://s/a", "the garden tools list garden tools list garden tools list", "garden", "content", 9), (2, "s", "https://s/b", "", "", "content", 0), (3, "s", "https://s/c", None, None, "content", 0)], "page_id long, site string, url string, main_text string, visible_text string, page_type string, word_count int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    phrases = pages.repeated_phrases(rows, 3)
    assert plan(phrases).count("regexp_extract_all") == 1
    assert {tuple(r) for r in phrases.collect()} == {(1, "garden tools list", 3)}
    html = spark.createDataFrame([(k, "<h1>Garden</h1>") for k in (1, 2, 3)], "page_id long, html string")
    evidence = au.evidence(rows.withColumns({c: F.lit(1) for c in ('paragraphs', 'headings')}), au.markup(html))
    assert "html" not in plan(evidence)
    assert {(r.page_id, r.unique_words, r.phrase4, r.keyword, tuple(r.heads)) for r in evidence.collect()} == {(1, 3, 0, "garden", ("garden",)), (2, 0, 0, None, ("garden",)), (3, 0, 0, None, ("garden",))}


def test_jaccard_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    docs = {k: " ".join(w if rng.random() > 0.01 * (k % 4) else "x" for w in base[k % 6]) for k in range(40)}
    sh = {k: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in docs.items()}
    want = {(i, j) for i in sh for j in sh if i < j and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= 0.8}
    table = neardup.shingle_sets(spark.createDataFrame(list(docs.items()), "k long, t string"), "k", "t")
    assert {(r.a, r.b) for r in neardup.jaccard_pairs(table, "k").collect()} == want and want


def test_layout_shift_windows(spark):
    def cls(*shifts):
        df = spark.createDataFrame([([tuple(map(float, s)) for s in shifts],)], "shifts array<struct<start:double,duration:double,value:double>>")
        return vitals.shift_windows(df).first().cls

    assert cls((0, 0, 0.1), (2000, 0, 0.1)) == 0.2  # a gap alone doesn't split
    assert cls((0, 0, 0.1), (5500, 0, 0.1), (7000, 0, 0.3)) == 0.3  # a gap after a long window does
    assert cls() == 0.0


def test_admission_ignores_rejected_events(spark):
    events = spark.createDataFrame([(1, k, t) for k, t in enumerate((0, 1, 2, 10, 11))], "user_id long, event_id long, t long")
    got = {r.event_id: r.admitted for r in st.admitted(events, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_admission_stream_keeps_state_between_files(spark, tmp_path):
    rows = [(1, k, t) for k, t in enumerate((0, 1, 2, 10, 11))] + [(2, 9, 5)]
    schema = "user_id long, event_id long, t long"
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = st.admission_stream(stream, 2, 10).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out.trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}


def test_addresses_with_dots_and_names(spark):
    df = spark.createDataFrame([("../x?a=/../b", "https://a.com/p/q/r", "http://u:p@Host.com:80//a/../b/./c/")], "href string, base string, url string")
    got = df.select(urls.resolve(F.col("href"), F.col("base")), urls.normalize(F.col("url")), urls.normalize(F.lit("https://a.com/../../z/.."))).first()
    assert tuple(got) == ("https://a.com/p/x?a=/../b", "http://host.com/b/c", "https://a.com/")


def test_robots_patterns_of_odd_paths(spark):
    df = spark.createDataFrame([("/a<end>b",), ("/x$",), ("/p$q*",)], "p string")
    assert [r[0] for r in df.select(robots.pattern(F.col("p"))).collect()] == ["^/a<end>b", "^/x$", "^/p\\$q.*"]


def test_scores_worked_out_by_hand(spark):
    counts = spark.createDataFrame([(100, 50, 5, 2, 1, 0, 0, 1, 0, 3), (1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (40, 9, 30, 9, 9, 9, 9, 9, 9, 9)], "internal int, external int, broken_internal int, broken_external int, dns_errors int, ssl_errors int, server_errors int, loops int, long_chains int, broken_anchors int")
    # 5 of 100 inside: 4 + 10 = 14; 2 of 50 outside: 2 + 1 = 3; 4 for a name, 8 for a loop, 4.5 for anchors: 66.5 rounds up
    assert [(r.score, r.grade) for r in profiles.link_score(counts).collect()] == [(67, "Needs Improvement"), (100, "Excellent"), (0, "Critical")]
    loads = spark.createDataFrame([(2500.0, 350.0, None, 1800.0), (None, None, None, 100.0), (9e9, 900.0, 0.2, None)], "lcp double, inp double, cls double, ttfb double")
    # (100 * 20 + 50 * 20 + 0 * 8) / 48 = 62.5; nothing of the core; (0 + 0 + 33 * 15) / 55 = 9
    assert [(r.score, r.grade) for r in profiles.tool_score(loads).collect()] == [(63.0, "Needs Improvement"), (None, None), (9.0, "Poor")]
    sites = spark.createDataFrame([(True, False, 4, 2, 0, 10, 50), (False, False, 0, 0, 3, 3, 5), (False, True, 2, 0, 0, 2, 10)], "challenge boolean, blocks_all boolean, parsed int, js_heavy int, errors int, fetched int, wanted int")
    assert [r.confidence for r in profiles.crawl_confidence(sites).collect()] == [45, 12, 60]


def test_inventory_bands(spark):
    rows = [("s", k, words, unique, 0.0) for k, (words, unique) in enumerate([(19, 60), (50, 9), (50, 10), (90, 50), (90, 70), (300, 90), (500, 200)])]
    got = pages.inventory(spark.createDataFrame(rows, "site string, page_id long, word_count int, unique_words long, boilerplate_ratio double"), F.col("page_id") < 6).first()
    # 0, 0, 0.2, 0.55, 0.55, 1 over six content pages
    assert (got.pages, got.content_pages, got.empty, got.thin, got.useful, got.useful_pct, got.thin_pct) == (7, 6, 2, 3, 2, 38.0, 83.0)


def test_page_types_by_precedence(spark):
    df = spark.createDataFrame([("/account", "", "", 0, 0), ("/blog/x", "t", "", 0, 0), ("/blog", "t", "", 0, 0), ("/x", "Privacy", "", 0, 0), ("/z", "t", "", 280, 2), ("/z", "t", "", 279, 2), ("/", "Contact", "", 0, 0)], "path string, title string, h1 string, w int, n int")
    assert [r[0] for r in df.select(profiles.page_type(F.col("path"), F.col("title"), F.col("h1"), F.col("w"), F.col("n"))).collect()] == ["login", "article", "blog", "privacy", "content", "other", "homepage"]


def test_mail_records(spark):
    df = spark.createDataFrame([("v=spf1 include:a  ~all ip4:1.2.3.4", "v=DMARC1; p = Quarantine ; p=none"), ("v=spf1 all", "v=DMARC1"), ("v=spf1 a mx", None)], "spf string, dmarc string")
    n, rule = domains.spf_fields(F.col("spf"))
    assert [tuple(r) for r in df.select(n, rule, domains.tag(F.col("dmarc"), "p")).collect()] == [(2, "~", "Quarantine"), (0, "+", None), (2, None, None)]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_long_form_needs_words_and_other_signs(spark):
    row = lambda site, kind, words, unique, paras, heads, ratio, sents: (site, kind, kind == "article", words, unique, paras, heads, ratio, sents)
    rows = [
        row("a", "article", 800, 160, 6, 0, 0.2, 1), row("a", "article", 499, 300, 9, 9, 0.0, 50), row("b", "article", 500, 159, 9, 9, 0.0, 50), row("b", "category", 39, 0, 0, 0, 0.0, 0),
        row("c", "other", 900, 900, 9, 9, 0.0, 50), row("d", "article", 500, 160, 4, 2, 0.5, 19), row("d", "article", 500, 160, 4, 2, 0.51, 20),
    ]
    got = by(au.long_form(spark.createDataFrame(rows, "site string, page_type string, content boolean, word_count int, unique_words int, paragraphs int, headings int, boilerplate_ratio double, sentences int")), "site")
    assert (got["a"].long_form, got["a"].coverage, got["a"].status, got["a"].requirement) == (1, 50.0, "passed", "Likely")
    assert (got["b"].long_form, got["b"].empty_categories, got["b"].status, got["b"].requirement) == (0, 1, "high", "Not Met")
    assert (got["c"].eligible, got["c"].status) == (0, "medium")
    assert (got["d"].long_form, got["d"].coverage) == (1, 50.0)


def test_markup_of_a_page(spark):
    html = """<html><head><meta name="author" content="Ann B"><script src="https://www.googletagmanager.com/gtag/js"></script><script src='//pagead2.googlesyndication.com/x.js'></script></head>
    <body><h1>Best <b>guide</b></h1><h2>Tips</h2><h3>No</h3><iframe src="https://x.example/ads/1"></iframe><ins class="adsbygoogle" data-ad-slot="3"></ins><a href="/f.zip">f</a> <a href="/download">d</a> <a target="_blank" href="https://s.example">s</a></body></html>"""
    plain = "<p class='byline'>By Cy</p>"
    got = by(au.markup(spark.createDataFrame([(1, html), (2, plain), (3, None)], "page_id long, html string")), "page_id")
    assert (got[1].heads, got[1].author, got[1].cited, got[1].slots, got[1].networks, got[1].downloads) == (["best guide", "tips"], "Ann B", True, 4, ["Google AdSense"], 2)
    assert (got[2].heads, got[2].author, got[2].cited, got[2].slots, got[2].networks) == ([], "By Cy", False, 0, [])
    assert got[3].author is None


def test_risks_of_pages(spark):
    kind = "site string, page_id long, content boolean, main_text string, author string, cited boolean, sources int, stock_intro boolean, phrase4 long, boilerplate_ratio double, unique_words int, keyword string, keyword_uses long, word_count int, heads array<string>"
    rows = [
        ("a", 1, True, "In conclusion, nothing.", None, False, 0, True, 8, 0.71, 20, "shoes", 14, 300, ["shoes", "best shoes", "top shoes", "vs guide"]),
        ("a", 2, True, "I tested it.", "Ann", False, 0, False, 0, 0.1, 100, "shoes", 14, 312, ["shoes"]), ("b", 3, False, "x", None, False, 0, False, 0, 0.0, 1, None, 0, 1, []),
    ]
    pages = spark.createDataFrame(rows, kind)
    assert {r.page_id: (r.risk, r.status) for r in au.search_first(pages).collect()} == {1: (8, "high"), 2: (0, "passed"), 3: (0, "passed")}
    assert {r.page_id: r.risk for r in au.human_signals(pages).collect()} == {1: 8, 2: 0}
    sites = by(au.human_involvement(pages), "site")
    assert (sites["a"].author_pct, sites["a"].first_pct, sites["a"].low_pct, sites["a"].status, sites["b"].status) == (50.0, 50.0, 50.0, "medium", "manual")


def test_scores_of_categories_and_sites(spark):
    findings = spark.createDataFrame(
        [
            ("a", "X", "content", "passed", "/x", 4, 100, None), ("a", "X", "content", "high", "Site", 4, 50, "3/4"), ("a", "X", "content", "info", "Site", 9, 100, None), ("a", "TECH_NOINDEX", "tech", "critical", "/", 5, None, "4%"), ("a", "X", "policy", "high", "/p", None, 100, None),
            ("b", "X", "monetization", "passed", "/", 3, 80, None), ("b", "EZ-HTTPS", "tech", "passed", "/", 3, 80, None),
        ],
        "site string, id string, category string, status string, page string, weight int, confidence int, affected string",
    )
    inventory = spark.createDataFrame([("a", 5, 80, 0, 0, "blog"), ("b", 5, 80, 0, 0, "blog"), ("c", 0, 0, 0, 0, "blog")], "site string, content_pages int, useful_pct int, thin_pct int, dup_pct int, site_type string")
    scores = au.category_scores(findings, inventory)
    got = by(scores, "site", "category")
    # 4 / (4 + 4 * 0.82 * 0.5 * 1.35 * 1.15) = 0.611
    assert (got["a", "content"].pct, got["a", "content"].score) == (61, 12)
    assert (got["a", "tech"].score, got["a", "policy"].score, got["a", "ux"].score) == (0, 0, 9)
    assert (got["b", "ezoic"].score, got["b", "tech"].score, got["c", "content"].pct, got["c", "content"].score) == (30, 15, 32, 6)
    sites = by(au.site_verdicts(scores, findings, inventory), "site")
    assert (sites["a"].total, sites["a"].caps, sites["a"].verdict) == (35, "noindex", "Not Ready")
    # 30 + 12 + 15 + 9 + 6 + 6
    assert (sites["b"].total, sites["b"].caps, sites["b"].verdict) == (78, "", "Likely Ready")
    assert sites["c"].verdict == "Needs Improvement"


def test_trust_and_traffic(spark):
    sites = spark.createDataFrame([("a", True, False, False), ("b", False, True, False)], "site string, email boolean, phone boolean, form boolean")
    found = spark.createDataFrame([("a", "privacy", 60, "We collect cookies.", True), ("a", "about", 59, "x", True), ("b", "privacy", 139, "x", True), ("b", "contact", 1, "x", False), ("b", "terms", 1, "x", False)], "site string, key string, words int, text string, linked boolean")
    got = {(r.site, r.id): r.status for r in au.trust(sites, found).collect()}
    assert [got["a", k] for k in ("privacy", "contact", "about", "terms")] == ["passed", "low", "medium", "low"]
    assert [got["b", k] for k in ("privacy", "contact", "about", "terms")] == ["medium", "passed", "medium", "passed"]
    pages = spark.createDataFrame([("a", "https://a.example/buy-traffic/", "Get paid to read. 3,000 monthly visitors", ["gtm.js"]), ("a", "https://a.example/", "traffic generator", [])], "site string, url string, visible_text string, script_urls array<string>")
    assert au.traffic_signals(pages).collect()[0].asDict() == {"site": "a", "exchange": 1, "incentive": 1, "claims": 1, "tracked": 1, "generators": 1}


def test_exports_keep_signs_and_nulls(spark):
    rows = spark.createDataFrame([(1, 'a, "b"\nc'), (2, " x "), (3, None)], "k long, v string")
    for kind in ("csv", "json"):
        assert {r.k: r.v for r in out.exported(rows, kind).collect()} == {1: 'a, "b"\nc', 2: " x ", 3: None}


def test_seo_facts_and_rules_of_literal_pages(spark):
    first = """<html lang="en"><head><title>Shoes for long walks in the hills</title><meta name="description" content="Short"><meta name="viewport" content="width=device-width"><link rel="canonical" href="https://a.com/"><link rel="alternate" hreflang="english" href="/en"><link rel="alternate" hreflang="en-US" href="/us">
    <script src="/a.js"></script><script defer src="https://cdn.x.com/b.js"></script><script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{bad</script><style>@media print{p{margin:0}}</style></head>
    <body><h1>Shoes</h1><h3>Skipped</h3><img src="http://a.com/1.webp" alt="one" width="1" height="1" loading="lazy"><img src="/2.png" alt=""><img src="/3.png"><a href="/x">x</a><a href="#top">top</a><a href="https://www.a.com/y"></a>
    <a href="https://b.com" target="_blank" rel="nofollow">b</a><a href="https://b.com/2" target="_blank" rel="noopener sponsored">b</a><article>shoes shoes</article></body></html>"""
    second = '<html><head><title>Shoes for long walks in the hills</title><meta name="robots" content="noindex, nofollow"></head><body></body></html>'
    raw = spark.createDataFrame([(1, "https://a.com/", first), (2, "https://a.com/b/", second), (3, "https://a.com/c", second)], "page_id long, url string, html string")
    f = pages.page_features(raw)
    fetched = spark.createDataFrame([(1, 200), (2, 404), (3, 301)], "page_id long, status int")
    rows = seo.page_facts(f, raw, fetched, pages.top_keywords(pages.page_tokens(f), 1)).cache()
    got = by(rows, "page_id")
    names = "h1s h2s headings skips keyword_in_title images no_alt empty_alt modern lazy unsized blocking foreign_scripts schemas bad_schema inner_links outer_links empty_anchors alternates bad_alternates media_queries mixed nofollow_links sponsored_links open_tabs"
    assert [got[1][n] for n in names.split()] == [1, 0, 2, True, True, 3, 1, 1, 1, 1, 2, 1, 1, 2, 1, 2, 2, 1, 2, 1, 1, 1, 1, 1, 1]
    assert (got[2].noindex, got[2].nofollow, got[2].images) == (True, True, 0)
    found = {(r.page_id, r["check"]): r.status for r in seo.checked(rows, seo.PAGE_RULES, "site", "page_id").collect()}
    assert [found[1, c] for c in ("HTTP status", "Canonical URL", "Title tag", "Meta description", "Heading hierarchy", "Word count", "Image alt text", "Structured data", "Empty anchor text")] == ["pass", "pass", "pass", "warning", "warning", "critical", "warning", "critical", "warning"]
    assert (found[2, "HTTP status"], found[3, "Redirect"], found[2, "No internal links"], found[2, "Image alt text"]) == ("critical", "warning", "critical", "info")
    assert (3, "HTTP status") not in found
    flags = "has_robots blocks_all has_sitemap hsts csp frame_options type_options referrer_policy permissions_policy gptbot claudebot perplexitybot google_extended".split()
    answer = spark.createDataFrame([("a.com", *[n in ("has_robots", "hsts", "gptbot") for n in flags], "br", "", 700)], "site string, " + ", ".join(f"{n} boolean" for n in flags) + ", encoding string, cache_control string, ms int")
    site = seo.site_facts(rows, answer).cache()
    assert [site.first()[n] for n in ("pages", "https", "home_lang", "slash_ends", "bare_ends", "shared_titles", "shared_descriptions", "shared_paths", "open_tabs")] == [3, True, "en", 1, 1, 1, 0, 0, 1]
    said = {(r["check"], r.weight): r.status for r in seo.checked(site, seo.SITE_RULES, "site").collect()}
    assert [said[k] for k in (("Trailing slash", 2), ("Duplicate titles", 4), ("Mixed content", 4), ("HSTS", 1), ("CSP", 3), ("GPTBot access", 2), ("Server response time", 2), ("Browser caching", 2))] == ["warning", "warning", "critical", "pass", "warning", "warning", "warning", "warning"]
    assert ("HSTS", 3) not in said and ("Duplicate URLs", 3) not in said


def test_seo_scores_leave_info_out(spark):
    rows = spark.createDataFrame([("a", "Images", 3, "info"), ("a", "Mobile", 5, "pass"), ("a", "Content", 4, "critical"), ("a", "Content", 1, "warning")], "site string, grp string, weight int, status string")
    got = {r.grp: (r.checks, r.score, r.grade) for r in seo.audit_scores(rows).collect()}
    # (5 * 100 + 4 * 0 + 1 * 60) / 10 and (0 + 60) / 5
    assert got == {None: (3, 56.0, "D"), "Mobile": (1, 100.0, "A"), "Content": (2, 12.0, "F")}


def test_categories_by_votes(spark):
    kind = "page_id long, path string, title string, headings string, segments array<string>, crumbs array<string>, types array<string>, og_type string, labels array<string>"
    rows = [
        (1, "/", "Docs", "", [], [], [], "", []), (2, "/x", "", "", ["x"], [], [], "", []), (3, "/blog/docs", "", "", ["blog", "docs"], [], [], "", []), (4, "/faq/blog", "", "", ["faq", "blog"], [], [], "", []),
        (5, "/blog/a", "Blog", "", ["blog", "a"], [], ["product", "article"], "product", []), (6, "/a", "A tool", "How to", ["a"], ["Our Team"], [], "", ["About", "Contact"]), (7, None, None, None, None, None, None, None, None),
    ]
    got = {r.page_id: (r.category, r.votes) for r in ca.categories(spark.createDataFrame(rows, kind)).collect()}
    # 5: Blog 4 + 5 + 2 against Products 5 + 3; 6: About 3 + 4
    assert got == {1: ("Home", 0), 2: ("Other", 0), 3: ("Documentation", 4), 4: ("FAQ", 4), 5: ("Blog", 11), 6: ("About", 7), 7: ("Other", 0)}


def test_phases_and_issues_of_loads(spark):
    loads = spark.createDataFrame([(1, 2500.0, 300.0, 800.0, 900.0), (2, 900.0, 400.0, 500.0, 100.0), (3, 900.0, 400.0, None, None), (4, 900.0, None, 500.0, None)], "load_id long, paint double, ttfb double, start double, duration double")
    got = by(ca.load_phases(loads), "load_id")
    assert [got[1][c] for c in ("load_delay", "load_duration", "render_delay", "bottleneck")] == [500.0, 900.0, 800.0, "Load duration"]
    assert (got[2].load_delay, got[2].bottleneck, got[3].load_delay, got[3].bottleneck, got[4].load_delay, got[4].bottleneck) == (100.0, "TTFB", None, None, 500.0, None)
    facts = spark.createDataFrame([(1, "lazy", True, False, "", 900, 400, 600000, "png", 5001, 41, 201.0, 6), (2, "eager", True, True, "", 800, 400, 512000, "png", 1500, 40, 200.0, 5), (3, None, None, None, None, None, None, None, None, None, None, None, None)], "load_id long, loading string, in_viewport boolean, preloaded boolean, fetchpriority string, natural_w int, rendered_w int, bytes long, format string, nodes long, depth int, longest_frame double, long_tasks int")
    found = ca.load_issues(facts).collect()
    assert {r.issue for r in found} == {"lcp-lazy", "lcp-priority", "lcp-oversized", "lcp-format", "dom-very-large", "dom-deep", "loaf", "mainthread-busy"} and {r.load_id for r in found} == {1}


def test_ratio_scores(spark):
    findings = spark.createDataFrame(
        [("a", "CONTENT_DUP_RATIO", "content", "high", "Site", 5, 100, None), ("a", "X", "content", "passed", "/x", 3, 50, None), ("a", "X", "content", "medium", "/x", 2, 100, None), ("a", "X", "trust", "passed", "/x", 3, 100, None), ("a", "POLICY_FINDING", "policy", "low", "Site", 3, 100, None), ("a", "TECH_HTTPS", "tech", "critical", "/", 3, 100, None)],
        "site string, id string, category string, status string, page string, weight int, confidence int, affected string",
    )
    inventory = spark.createDataFrame([("a", 5, 80, 0, 0, "blog")], "site string, content_pages int, useful_pct int, thin_pct int, dup_pct int, site_type string")
    scores = au.ratio_scores(findings, inventory)
    # content 0.7 * 0.2 + 0.3 * 3 / (3 + 2 * 0.45) = 0.371; policy 0.85; tech 0.4; else 1.0 or 0.65
    assert {r.category: (r.pct, r.score) for r in scores.collect()} == {"content": (37, 9), "trust": (100, 20), "policy": (85, 17), "ux": (65, 10), "tech": (40, 4), "perf": (65, 7)}
    assert [tuple(r) for r in au.ratio_verdicts(scores, findings, inventory).select("total", "verdict").collect()] == [(55, "Needs Improvement")]


def test_budget_and_shift_streams_keep_state_between_files(spark, tmp_path):
    def run(rows, schema, query, mode, name):
        got = []
        for part in rows:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
            out = query(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}/state").foreachBatch(lambda b, _: got.extend(b.collect()))
            out.trigger(availableNow=True).start().awaitTermination()
        return got

    rows = [[(1, 1, 2, 5.0), (1, 0, 1, None), (2, 9, 1, 11.0)], [(1, 2, 3, 5.0), (1, 3, 4, 0.5), (2, 10, 2, 0.0)]]
    got = run(rows, "user_id long, event_id long, ts long, value double", lambda s: st.budget_stream(s, 4, 10.0), "append", "budget")
    assert {r.event_id: r.within for r in got} == {0: True, 1: True, 2: True, 3: False, 9: False, 10: False}
    rows = [[(1, 5500.0, 0.0, 0.1), (1, 0.0, None, 0.1), (2, 0.0, 0.0, 0.1)], [(1, 7000.0, 0.0, 0.3), (2, 2000.0, 0.0, 0.1)]]
    got = run(rows, "load_id long, start double, duration double, value double", st.shift_stream, "update", "shift")
    best = {}
    for r in got:
        best[r.load_id] = max(best.get(r.load_id, 0), round(r.best, 4))
    assert best == {1: 0.3, 2: 0.2}


def test_shifts_of_a_later_batch_count_in_time_order(spark, tmp_path):
    schema = "load_id long, start double, duration double, value double"
    for k, part in enumerate([[(1, 4000.0, 0.0, 0.1), (1, 6000.0, 0.0, 0.2), (2, 0.0, 0.0, 0.1)], [(1, 0.0, 0.0, 0.1), (1, 8000.0, 0.0, 0.05)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/[01]")
    # 0, 4000 and 6000 are one window of 0.4, as it is open over 5 s only then, and 8000 is another
    assert {r.load_id: round(r.best, 4) for r in st.drain(st.shift_stream(stream), "shifts", "update", "load_id").collect()} == {1: 0.4, 2: 0.1}


def test_depth_within_some_clicks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(0, 2)], "src long, dst long")
    home = spark.createDataFrame([(0,)], "page_id long")
    found = lambda most: {r.page_id: r.depth for r in links.click_depth(edges, home, most).collect()}
    assert found(0) == {0: 0} and found(2) == {0: 0, 1: 1, 2: 1, 3: 2} and found(9) == found(None) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4}


def test_queries_on_depth_follow_all_clicks(spark, tmp_path):
    import duckdb

    from pagelode.plans import site_queries as sq

    n = 5_184  # the least page that is 13 clicks from the first, by the one after it
    spark.range(1, n + 2).selectExpr("id AS page_id", "concat('https://a.example/', id) AS url", "'<p>' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    row = sq.architecture_stats(spark, str(tmp_path)).collect()
    assert [r.max_depth for r in row] == [13] and [tuple(r) for r in row] == con.execute(sq.ORACLES["architecture_stats"]).fetchall()
    issues = {tuple(r) for r in sq.link_position_issues(spark, str(tmp_path)).collect()}
    assert ("a.example", n, "deep") in issues and issues == set(con.execute(sq.ORACLES["link_position_issues"]).fetchall())


def test_sentences_of_a_long_text_without_an_end(spark):
    import time

    from pagelode.functions import text as tx

    long = "word " * 60_000
    rows = spark.createDataFrame([(1, f"A b.\nC d?! e{long}"), (2, long), (3, "..."), (4, ""), (5, None), (6, "a. ")], "k int, t string").repartition(1)
    began = time.time()
    got = {r.k: r.s for r in rows.select("k", tx.sentences(F.col("t")).alias("s")).collect()}
    assert got == {1: ["A b.", "\nC d?!"], 2: [long], 3: ["..."], 4: [], 5: [], 6: ["a."]}
    assert time.time() - began < 20
