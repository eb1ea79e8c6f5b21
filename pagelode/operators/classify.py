"""Indexability, page types, checks and scores of pages.

Rules are SQL text over the columns of page_features joined to fetch facts, so that profiles can be
kept as data; Catalyst compiles them like any other expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx

#: Reasons in order of precedence.
INDEXABILITY = """CASE WHEN blocked THEN 'Blocked by robots.txt' WHEN status BETWEEN 300 AND 399 THEN 'Redirect' WHEN status = 404 THEN '404'
 WHEN status = 410 THEN '410' WHEN status >= 500 THEN 'Server error' WHEN status IN (401, 403, 429) THEN 'Unverifiable' WHEN status <> 200 THEN 'Not 200'
 WHEN content_type NOT LIKE '%html%' THEN 'Not HTML' WHEN noindex THEN 'Noindex' ELSE 'Indexable' END"""
EXCLUDED = {
    "admin": "Private", "login": "Private", "account": "Private", "cart": "Commerce flow", "checkout": "Commerce flow", "tag": "Archive",
    "tags": "Archive", "author": "Archive", "category": "Archive", "search": "Search results", "feed": "Feed", "wp-json": "Technical", "cdn-cgi": "Technical",
}
PAGE_TYPE = """CASE WHEN path = '/' OR path = '' THEN 'home' WHEN lower(path) LIKE '%about%' THEN 'about' WHEN lower(path) LIKE '%contact%' THEN 'contact' WHEN lower(path) LIKE '%privacy%' THEN 'privacy'
 WHEN path LIKE '%.html' THEN 'article' WHEN word_count >= 800 THEN 'guide' WHEN word_count >= 300 THEN 'article' WHEN word_count >= 80 THEN 'post' ELSE 'thin' END"""
#: (check, group, condition under which it fails, severity, weight)
CHECKS = (
    ("status", "technical", "status <> 200", "critical", 10),
    ("https", "technical", "scheme <> 'https'", "warning", 6),
    ("canonical", "technical", "canonical = ''", "warning", 4),
    ("noindex", "technical", "noindex", "critical", 10),
    ("title_length", "on_page", "length(title) < 12 OR length(title) > 70", "warning", 5),
    ("one_h1", "on_page", "h1_count <> 1", "warning", 5),
    ("thin", "content", "word_count < 150", "warning", 6),
    ("long_page", "content", "html_bytes > 8000", "warning", 2),
    ("paragraphs", "content", "paragraphs < 2", "warning", 2),
    ("viewport", "mobile", "NOT has_viewport", "critical", 8),
    ("navigation", "linking", "NOT has_nav", "warning", 4),
    ("footer", "linking", "NOT has_footer", "warning", 2),
    ("lang", "international", "lang = ''", "warning", 3),
    ("ad_density", "monetisation", "ad_slots >= 1 AND word_count < 120", "warning", 4),
)
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"
IMPORTANCE = """least(99, greatest(0, (CASE depth WHEN 0 THEN 25 WHEN 1 THEN 18 WHEN 2 THEN 10 WHEN 3 THEN 6 ELSE 3 END)
 + (CASE WHEN in_links >= 20 THEN 18 WHEN in_links >= 10 THEN 14 WHEN in_links >= 5 THEN 10 WHEN in_links >= 2 THEN 6 ELSE 2 END)
 + (CASE WHEN length(title) = 0 THEN 0 WHEN length(title) BETWEEN 10 AND 70 THEN 10 WHEN length(title) BETWEEN 5 AND 140 THEN 5 ELSE 2 END)
 + (CASE WHEN word_count >= 800 THEN 14 WHEN word_count >= 400 THEN 11 WHEN word_count >= 200 THEN 8 WHEN word_count >= 80 THEN 5 ELSE 1 END)
 + (CASE WHEN h1 <> '' THEN 5 ELSE 0 END) + (CASE WHEN params = 0 THEN 5 WHEN params = 1 THEN 3 ELSE 0 END)
 + (CASE WHEN title <> '' THEN 2 ELSE 0 END) + (CASE WHEN h1 <> '' THEN 2 ELSE 0 END)
 + (CASE page_type WHEN 'home' THEN 40 WHEN 'guide' THEN 24 WHEN 'article' THEN 12 WHEN 'about' THEN 16 ELSE 4 END)))"""
#: What a category adds to a page's importance, or takes from it.
CATEGORY_POINTS = (
    ("Home", 40), ("Documentation", 30), ("Knowledge Base", 26), ("Guides", 24), ("Tutorials", 22), ("Services", 22), ("Products", 20), ("Tools", 18), ("FAQ", 16), ("About", 16), ("Contact", 12), ("Resources", 12), ("Blog", 12), ("Other", 4),
    ("Categories", -20), ("Authors", -20), ("Tags", -40), ("Utility", -45),
)
BAND = "CASE WHEN importance >= 80 THEN 'High' WHEN importance >= 55 THEN 'Medium' ELSE 'Low' END"


def suitability(segments: Column, params: Column, tracking: Column) -> Column:
    """Why a URL is unfit for a curated list; null if it is fit."""
    table = F.create_map(*[F.lit(x) for pair in EXCLUDED.items() for x in pair])
    hit = F.array_min(F.filter(F.transform(segments, lambda s: table[s]), lambda r: r.isNotNull()))
    return F.when(hit.isNotNull(), hit).when(tracking, "Tracking").when(params >= 2, "Parameters")


def importance(pages: DataFrame) -> DataFrame:
    """pages with (importance, band) by all terms: depth, inlinks, navigation or footer, sitemap, title, words,
    headings, canonical, address, breadcrumbs, five kinds of metadata, category. A home page has 100,
    others 99 at most. pages (category, depth, inlinks, nav_linked, footer_linked, in_sitemap, title,
    word_count, h1, h2_count, canonical, canonicalised, params, crumbs, description, og)."""
    c = F.col
    filled = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    yes = lambda x, n: F.when(F.coalesce(x, F.lit(False)), n).otherwise(0)

    def steps(value: Column, rows: tuple[tuple[float, int], ...], rest: int) -> Column:
        return F.coalesce(*[F.when(value >= least, n) for least, n in rows], F.lit(rest))

    size = F.length(F.trim(F.coalesce("title", F.lit(""))))
    title = F.when(size == 0, 0).when(size.between(10, 70), 10).when(size.between(5, 140), 5).otherwise(2)
    depth = F.coalesce("depth", F.lit(0))
    near = F.when(depth == 0, 25).when(depth == 1, 18).when(depth == 2, 10).when(depth == 3, 6).otherwise(3)
    known = sum((filled(c(x)).cast("int") for x in ("title", "description", "og", "canonical", "h1")), F.lit(0))
    category = F.coalesce(*[F.when(c("category") == name, points) for name, points in CATEGORY_POINTS], F.lit(0))
    total = (
        near + steps(F.coalesce("inlinks", F.lit(0)), ((20, 18), (10, 14), (5, 10), (2, 6)), 2) + F.when(F.coalesce("nav_linked", F.lit(False)), 20).when(F.coalesce("footer_linked", F.lit(False)), 8).otherwise(0) + yes(c("in_sitemap"), 10) + title
        + steps(F.coalesce("word_count", F.lit(0)), ((800, 14), (400, 11), (200, 8), (80, 5)), 1) + yes(filled(c("h1")), 5) + yes(c("h2_count") >= 2, 5) + yes(filled(c("canonical")) & ~F.coalesce("canonicalised", F.lit(False)), 4)
        + F.when(c("params") == 0, 5).when(c("params") == 1, 3).otherwise(0) + yes(c("crumbs") >= 2, 4) + known * 2 + category
    )
    value = F.when(c("category") == "Home", 100).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), total))).cast("int")
    return pages.withColumn("importance", value).withColumn("band", F.expr(BAND))


def findings(facts: DataFrame) -> DataFrame:
    """(site, page_id, check, grp, severity, weight): failed checks, in long form."""
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(g).alias("grp"), F.lit(s).alias("severity"), F.lit(w).alias("weight"), F.expr(p).alias("failed")) for c, g, p, s, w in CHECKS])
    return facts.select("site", "page_id", F.explode(rows).alias("f")).where("f.failed").select("site", "page_id", "f.check", "f.grp", "f.severity", "f.weight")


def check_scores(facts: DataFrame) -> DataFrame:
    """(site, grp, score, grade): weighted mean of 100 for passed, 60 for warned and 0 for critical
    checks, per group and, with grp null, in all."""
    value = lambda s: 60 if s == "warning" else 0
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(w).alias("weight"), F.when(F.expr(p), value(s)).otherwise(100).alias("value")) for c, g, p, s, w in CHECKS])
    long = facts.select("site", F.explode(rows).alias("r")).select("site", "r.*")
    out = long.rollup("site", "grp").agg(tx.half_up(F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("score")).where("site is not null")
    return out.select("site", "grp", "score", F.expr(GRADE).alias("grade"))


def issue_matrix(found: DataFrame) -> DataFrame:
    """(site, page_id, a count column for each group): issues per group per page."""
    groups = sorted({g for _, g, *_ in CHECKS})
    return found.groupBy("site", "page_id").pivot("grp", groups).agg(F.count("check")).fillna(0)


def priorities(found: DataFrame, most: int = 40) -> DataFrame:
    """(site, rank, page_id, check): critical before warning, heavier first."""
    order = Window.partitionBy("site").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), F.desc("weight"), "check", "page_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("site", "rank", "page_id", "check")


def histograms(found: DataFrame) -> DataFrame:
    """(grp, severity, n): counts by either, the other being null."""
    both = F.grouping_id()
    return found.groupingSets([[F.col("grp")], [F.col("severity")]], F.col("grp"), F.col("severity")).agg(F.count("*").alias("n"), both.alias("g")).drop("g")


def sections(pages: DataFrame, caps: tuple[tuple[str, int], ...]) -> DataFrame:
    """(site, section, rank, page_id): each page in the first section of caps that has its type and room
    left, best pages first."""
    left, out = pages, None
    for name, cap in caps:
        kind = F.lit(True) if name == "important" else F.col("page_type") == name
        order = Window.partitionBy("site").orderBy(F.desc("importance"), "page_id")
        taken = left.where(kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        part = taken.select("site", F.lit(name).alias("section"), "rank", "page_id")
        out = part if out is None else out.unionByName(part)
        left = left.join(taken.select("page_id"), "page_id", "left_anti")
    return out


def eligibility(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, score, verdict): 100 less the weighted share of pages with findings, capped where half of
    a site's pages have a critical one."""
    n = pages.groupBy("site").agg(F.count("*").alias("pages"))
    per = found.groupBy("site", "check", "severity", "weight").agg(F.count_distinct("page_id").alias("hit"))
    rows = per.join(n, "site").groupBy("site").agg(F.sum(F.col("weight") * F.col("hit") / F.col("pages")).alias("lost"), F.max(F.when(F.col("severity") == "critical", F.col("hit") / F.col("pages"))).alias("critical"))
    raw = F.greatest(F.lit(0.0), 100 - F.col("lost"))
    score = tx.half_up(F.when(F.col("critical") >= 0.5, F.least(raw, F.lit(55.0))).otherwise(raw))
    scored = n.join(rows, "site", "left").select("site", "pages", F.coalesce(score, F.lit(100.0)).alias("score"))
    return scored.withColumn("verdict", F.when(F.col("score") >= 70, "ready").when(F.col("score") >= 40, "needs work").otherwise("not ready"))
