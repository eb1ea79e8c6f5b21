"""Rule profiles as data: page types, site types, bot walls, crawl order, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators.domains import cases

#: Page types in order of precedence, by a pattern on the path, or on title, heading and path.
#: (type, path pattern, text pattern); both must hold where both are given.
PAGE_TYPES = (
    ("login", r"/(login|signin|sign-in|log-in|register|signup|account|auth)(/|$)", ""), ("search", r"/search|/find", ""), ("author", r"/(author|user|profile|members)/", ""), ("homepage", r"^/?$", ""),
    ("privacy", "", "privacy"), ("contact", "", "contact"), ("about", "about", r"(^|[^a-z0-9_])about($|[^a-z0-9_])"), ("terms", "terms|legal", "terms|conditions"), ("disclaimer", "", "disclaimer"), ("privacy", "cookie", "cookie"),
    ("article", r"/(blog|news|article|post|story|guide|tutorial)/", ""), ("blog", r"/(blog|news|articles|posts)/?$", ""), ("product", r"/(product|item|shop|buy|pricing|plan)", ""),
    ("category", r"/(category|collection|tag|topics)($|[^a-z0-9_])", ""), ("tool", r"/(tool|calculator|converter|generator|checker|app)($|[^a-z0-9_])", ""), ("directory", r"/(directory|listings?|sites)/", ""),
    ("docs", r"/(docs?|documentation|api|reference)($|[^a-z0-9_])", ""), ("forum", r"/(forum|thread|topic)($|[^a-z0-9_])", ""),
)
#: Evidence of a site's kind, its weight, in the order that breaks ties.
SITE_TYPES = (
    ("blog", "blog|article|posted on|leave a comment|byline", 3), ("news", "news|breaking|headline|press release", 3), ("saas", "pricing|free trial|sign up|saas|dashboard|subscribe", 3),
    ("tools", r"calculator|converter|generator|checker|(^|[^a-z0-9_])tool($|[^a-z0-9_])", 4), ("directory", "directory|submit (your )?site|listings", 3), ("ecommerce", "add to cart|woocommerce|shopify|checkout|sku|product price", 5),
    ("business", r"services|solutions|consulting|enterprise|(^|[^a-z0-9_])(llc|inc)($|[^a-z0-9_])", 2), ("portfolio", "portfolio|selected work|case study|my work", 2),
    ("educational", "course|lesson|curriculum|university|academy", 3), ("documentation", "documentation|api reference|getting started|sdk", 3), ("forum", "forum|thread|replies|community", 3),
)
#: What is crawled first.
CRAWL_ORDER = (
    (r"/(about|who-we-are|our-story|company|team)(/|$)", 100), (r"/(contact|get-in-touch|reach)(/|$)", 99), ("privacy", 98), ("terms|conditions|tos", 97), ("disclaimer", 96), ("cookie", 95),
    (r"/(blog|article|post|news|guide|tutorial|review)/", 70), (r"/(product|shop|pricing|plan)", 55), (r"/(category|collection|topics)", 40), (r"/$", 80),
)
#: Metric, weight, good up to, poor from.
PERFORMANCE = (("lcp", 20, 2500, 4000), ("inp", 20, 200, 500), ("cls", 15, 0.1, 0.25), ("ttfb", 8, 800, 1800), ("fcp", 8, 1800, 3000), ("tbt", 9, 200, 600))
CONTENT_TYPES = ("content", "article", "blog")


def page_type(path: Column, title: Column, heading: Column, words: Column, headings: Column) -> Column:
    """The first type whose patterns hold; long text under headings is content, all else other."""
    p, t = F.lower(path), F.lower(F.concat_ws(" ", title, heading, path))
    holds = lambda x, y: (p.rlike(x) if x else F.lit(True)) & (t.rlike(y) if y else F.lit(True))
    return cases([*[(holds(x, y), kind) for kind, x, y in PAGE_TYPES], ((words >= 280) & (headings >= 2), "content")], "other")


def site_type(pages: DataFrame) -> DataFrame:
    """(site, site_type) of pages (site, text, page_type): the kind with most evidence, in the order of
    SITE_TYPES; weak evidence leaves a blog where many pages are articles, else a business."""
    seen = pages.groupBy("site").agg(*[F.bool_or(F.lower("text").rlike(p)).alias(k) for k, p, _ in SITE_TYPES], F.count("*").alias("n"), F.count_if(F.col("page_type").isin(*CONTENT_TYPES)).alias("articles"))
    weight = lambda k, w: F.when(F.col(k), w).otherwise(0)
    most = F.greatest(*[weight(k, w) for k, _, w in SITE_TYPES])
    best = cases([(weight(k, w) == most, k) for k, _, w in SITE_TYPES])
    weak = F.when(F.col("articles") >= F.greatest(F.lit(3.0), F.col("n") * 0.4), "blog").otherwise("business")
    return seen.select("site", F.when(most <= 1, weak).otherwise(best).alias("site_type"))


def crawl_priority(url: Column) -> Column:
    return cases([(F.lower(url).rlike(p), w) for p, w in CRAWL_ORDER], 10)


def bot_wall(body: Column, server: Column, status: Column) -> Column:
    """Whose wall against bots an answer is; null if it is none."""
    b, s = F.lower(F.substring(body, 1, 20_000)), F.lower(F.coalesce(server, F.lit("")))
    has = b.contains
    cloud = ((has("just a moment") | has("attention required")) & has("cloudflare")) & (has("captcha") | has("challenge") | status.isin(403, 503))
    return cases([
        (cloud, "Cloudflare"), (has("captcha") & (has("recaptcha") | has("hcaptcha") | has("turnstile")), "CAPTCHA"), (s.contains("imperva") | has("imperva"), "Imperva"),
        (has("sucuri") & has("cloudproxy"), "Sucuri"), (has("akamai") & (has("access denied") | (status == 403)) & (has("bot") | has("automated")), "Akamai"), (has("datadome"), "DataDome"), (has("perimeterx"), "PerimeterX"),
        (status.isin(403, 503) & has("blocked") & (has("bot") | has("automated")), "Unknown"),
    ])


def heading_skips(levels: Column) -> Column:
    """Whether a list of heading levels goes down by more than one somewhere, from 1."""
    before = F.concat(F.array(F.lit(1)), levels)
    return F.exists(F.zip_with(levels, F.slice(before, 1, F.size(levels)), lambda a, b: a > b + 1), lambda x: x)


def slash_use(pages: DataFrame) -> DataFrame:
    """(site, with_slash, without_slash, mixed) of the paths but the root."""
    rows = pages.where("path not in ('', '/')").groupBy("site").agg(F.count_if(F.endswith("path", F.lit("/"))).alias("with_slash"), F.count_if(~F.endswith("path", F.lit("/"))).alias("without_slash"))
    return rows.withColumn("mixed", (F.col("with_slash") > 0) & (F.col("without_slash") > 0))


def link_score(counts: DataFrame) -> DataFrame:
    """counts with (score, grade): 100 less a capped penalty for each kind of trouble with links."""
    c, up = F.col, tx.half_up
    share = lambda n, of: c(n) / F.greatest(F.lit(1), c(of))
    inner = F.least(F.lit(40.0), up(share("broken_internal", "internal") * 80 + c("broken_internal") * 2))
    inner = F.when(c("broken_internal") >= 20, F.least(F.lit(50.0), inner + 10)).when(c("broken_internal") > 0, inner).otherwise(0.0)
    outer = F.when(c("broken_external") > 0, F.least(F.lit(15.0), up(share("broken_external", "external") * 50 + c("broken_external") * 0.5))).otherwise(0.0)
    each = [F.least(F.lit(float(most)), c(n) * by) for n, by, most in (("dns_errors", 4, 20), ("ssl_errors", 3, 15), ("server_errors", 3, 20), ("loops", 8, 25), ("long_chains", 2, 10), ("broken_anchors", 1.5, 10))]
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), up(100 - inner - outer - sum(each[1:], each[0])))).cast("long")
    grade = cases([(c("score") < 25, "Critical"), (c("score") < 50, "Poor"), (c("score") < 75, "Needs Improvement"), (c("score") < 90, "Good")], "Excellent")
    return counts.withColumn("score", score).withColumn("grade", grade)


def between(value: Column, good: float, poor: float) -> Column:
    """100 up to good, 0 from poor on, a straight line between; null if unmeasured."""
    line = tx.half_up((1 - (value - good) / (poor - good)) * 100)
    return F.when(value.isNull(), None).when(value <= good, 100.0).when(value >= poor, 0.0).otherwise(line)


#: The parts of a load's efficiency and their weights.
EFFICIENCY = (("resource_part", 8), ("network_part", 6), ("rendering_part", 6))


def efficiency(loads: DataFrame) -> DataFrame:
    """loads (requests, bytes, static, cacheable, text, compressed, tasks, nodes) with resource_part, network_part
    and rendering_part, 0 to 100 each: of requests and bytes, of cacheable and compressed shares, of long
    tasks and the size of the document; null where what it needs wasn't measured."""
    c, up = F.col, tx.half_up
    within = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    resource = up((within(100 - (c("requests") - 20) * 1.1) + within(100 - (c("bytes") / 1024 - 400) / 40)) / 2)
    cached = up(F.when(c("static") > 0, c("cacheable") / c("static")).otherwise(1.0) * 60)
    packed = F.when(c("text") > 0, up(c("compressed") / c("text") * 40)).otherwise(0.0)
    big = F.when(c("nodes") > 5000, 25).when(c("nodes") > 2000, 10).otherwise(0)
    return loads.withColumns({
        "resource_part": F.when((c("requests") > 0) & c("bytes").isNotNull(), resource), "network_part": F.when(c("static").isNotNull(), within(cached + packed)),
        "rendering_part": F.when(c("tasks").isNotNull(), within(up(within(100 - (c("tasks") - 2) * 8)) - big)),
    })


def tool_score(loads: DataFrame) -> DataFrame:
    """loads with (score, grade): the weighted mean of what was measured, the parts of efficiency() among it
    where they are there; null without any of lcp, inp, cls."""
    parts = [(between(F.col(m), g, p), w) for m, w, g, p in PERFORMANCE if m in loads.columns] + [(F.col(m), w) for m, w in EFFICIENCY if m in loads.columns]
    weight = sum((F.when(s.isNotNull(), w).otherwise(0) for s, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0))
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    core = F.coalesce(*[F.col(m).cast("double") for m in ("lcp", "inp", "cls") if m in loads.columns]).isNotNull()
    mean = F.when(core, total / weight)
    grade = F.when(mean >= 90, "Good").when(mean >= 50, "Needs Improvement").when(mean.isNotNull(), "Poor")
    return loads.withColumns({"score": tx.half_up(mean), "grade": grade})


def protection_score(sites: DataFrame) -> DataFrame:
    """sites (known, blocked, wildcard, errors, warnings, enforced, own_groups, whole_site, paths) with
    (score, label): six components of 40, 15, 10, 20, 10 and 5 points at most."""
    c = F.col
    covered = F.when(c("wildcard"), c("known")).otherwise(c("blocked"))
    coverage = F.when(c("known") > 0, tx.half_up(F.least(F.lit(1.0), covered / c("known")) * 40)).otherwise(0.0)
    lint = lambda good, fair: F.when(c("errors") > 0, 0).when(c("warnings") > 0, fair).otherwise(good)
    paths = F.when(c("whole_site"), 5).when(c("paths") > 0, 3).otherwise(0)
    score = (coverage + lint(15, 10) + lint(10, 6) + F.when(c("enforced"), 20).otherwise(0) + F.when(c("own_groups") > 0, 10).otherwise(0) + paths).cast("long")
    return sites.withColumn("score", score).withColumn("label", cases([(c("score") >= 85, "Strong configuration"), (c("score") >= 60, "Moderate protection"), (c("score") >= 35, "Basic protection")], "Minimal protection"))


def crawl_confidence(sites: DataFrame) -> DataFrame:
    """sites (challenge, blocks_all, parsed, js_heavy, errors, fetched, wanted) with `confidence`, 12 to 96."""
    c = F.col
    base = 90 - F.when(c("challenge"), 25).otherwise(0) - F.when(c("blocks_all"), 20).otherwise(0)
    read = F.when(c("parsed") == 0, 15).otherwise(base - F.when(c("js_heavy") / c("parsed") >= 0.5, 20).otherwise(0))
    left = read - F.when(c("errors") >= F.greatest(F.lit(3.0), c("fetched") * 0.4), 15).otherwise(0) - F.when((c("parsed") < 3) & (c("wanted") >= 10), 10).otherwise(0)
    return sites.withColumn("confidence", F.least(F.lit(96), F.greatest(F.lit(12), left)).cast("long"))


def feed_score(items: DataFrame, stats: DataFrame) -> DataFrame:
    """(site, items, score) of a feed's items (site, title, link, description, dated, canonical, content) and
    stats (site, valid, duplicates, broken): eight components of 20, 15, 15, 15, 10, 10, 10 and 5."""
    share = lambda x: F.avg(F.when(x, 1.0).otherwise(0.0))
    filled = F.when(F.col("title") != "", 0.4).otherwise(0.0) + F.when(F.col("link") != "", 0.3).otherwise(0.0) + F.when(F.col("description") != "", 0.3).otherwise(0.0)
    sums = items.groupBy("site").agg(
        F.count("*").alias("items"), share(F.col("link").rlike("^https?://[^/]")).alias("u"), F.avg(filled).alias("f"), share(F.col("dated")).alias("d"), share(F.col("canonical") == F.col("link")).alias("c"), share(F.col("content")).alias("r")
    )
    one = lambda x: tx.half_up(x, 1)
    kept = lambda lost: one(10 * F.col("items") / (F.col("items") + F.col(lost)))
    total = F.when(F.col("valid"), 20.0).otherwise(0.0) + one(15 * F.col("u")) + one(15 * F.col("f")) + one(15 * F.col("d")) + kept("duplicates") + kept("broken") + one(10 * F.col("c")) + one(5 * F.col("r"))
    return sums.join(stats, "site").select("site", "items", F.least(F.lit(100.0), tx.half_up(total)).cast("long").alias("score"))


def feed_class(pages: DataFrame) -> DataFrame:
    """pages (path, words, has_article, has_date, links) with (type, feedable): paths of indexes first, then
    products and documentation, then length and marks of articles, then fixed pages."""
    p, w, a, dt = F.lower("path"), F.col("words"), F.col("has_article"), F.col("has_date")
    posts, guides = "blog|post|posts|article|articles|news|press|updates|insights|journal|stories|story|media", "guide|guides|how-to|howto|tutorial|tutorials|resources"
    fixed = "about|about-us|contact|contact-us|privacy|privacy-policy|terms|terms-of-service|cookies|cookie-policy|disclaimer|sitemap|search|login|log-in|signin|sign-in|register|signup|sign-up|cart|checkout|account|pricing|careers|jobs|imprint|legal|licensing|media-kit|404|home"
    index = p.rlike(f"^/({posts}|{guides})/[^/]+/?$") & (F.col("links") >= 8) & ~a & ~dt & (w < 120)
    kind = cases([
        (p == "/", "Homepage"), (p.rlike("^/(tag|tags)/"), "Tag"), (p.rlike("^/(author|authors|writers?|staff)/|^/by/[^/]+/?$"), "Author"), (p.rlike("^/(category|categories|section|sections|topic|topics|c)/"), "Category"), (index, "Category"),
        (p.rlike("^/(docs|documentation|reference|api|developer|developers|manual|knowledge-base|kb|help|support|faq|faqs)/"), "Documentation"), (p.rlike("^/(product|products|shop|store|item|items|cart|checkout|account|wishlist)/"), "Product"),
        (a & dt & (w >= 80) | a & (w >= 150) | dt & (w >= 150), "Article"), (p.rlike(f"^/({posts})/") & (w >= 60), "Blog Post"), (p.rlike(f"^/({guides})/") & (w >= 60), "Guide"), (p.rlike(f"^/({fixed})(/|$)"), "Static Page"),
    ], "Other")
    return pages.withColumn("type", kind).withColumn("feedable", F.col("type").isin("Article", "Blog Post", "News Article", "Guide"))
