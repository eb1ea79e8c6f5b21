"""The search audit's checks as rule tables over facts of pages and sites.

A rule is (group, check, weight, status), the status as SQL text over the facts' columns: pass, warning, critical
or info; null where the check says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators import profiles as pf
from pagelode.operators.classify import GRADE

PAGE_RULES = (
    ("Technical", "HTTP status", 5, "CASE WHEN status >= 400 THEN 'critical' END"),
    ("Technical", "HTTP status", 1, "CASE WHEN status < 300 THEN 'pass' END"),
    ("Technical", "Redirect", 3, "CASE WHEN status BETWEEN 300 AND 399 THEN 'warning' END"),
    ("Technical", "Noindex meta", 5, "CASE WHEN noindex THEN 'critical' END"),
    ("Technical", "Meta robots", 1, "CASE WHEN NOT noindex THEN 'pass' END"),
    ("Technical", "Nofollow meta", 2, "CASE WHEN nofollow THEN 'warning' END"),
    ("Technical", "Canonical URL", 3, "CASE WHEN canonical = '' OR canonical <> own_url AND own_canonical THEN 'warning' END"),
    ("Technical", "Canonical URL", 1, "CASE WHEN canonical <> '' AND (canonical = own_url OR NOT own_canonical) THEN 'pass' END"),
    ("Technical", "URL length", 1, "CASE WHEN length(url) > 115 THEN 'warning' END"),
    ("On page", "Title tag", 5, "CASE WHEN title = '' THEN 'critical' WHEN length(title) BETWEEN 30 AND 60 THEN 'pass' ELSE 'warning' END"),
    ("On page", "Meta description", 3, "CASE WHEN length(description) BETWEEN 120 AND 160 THEN 'pass' ELSE 'warning' END"),
    ("On page", "H1", 5, "CASE h1s WHEN 1 THEN 'pass' WHEN 0 THEN 'critical' ELSE 'warning' END"),
    ("On page", "Heading structure", 2, "CASE WHEN h2s >= 1 THEN 'pass' ELSE 'warning' END"),
    ("On page", "Heading hierarchy", 2, "CASE WHEN skips THEN 'warning' ELSE 'pass' END"),
    ("On page", "Keyword placement", 3, "CASE WHEN keyword_uses > 1 THEN CASE WHEN keyword_in_title AND keyword_in_h1 THEN 'pass' ELSE 'warning' END END"),
    ("Content", "Word count", 4, "CASE WHEN words >= 500 THEN 'pass' WHEN words >= 250 THEN 'warning' ELSE 'critical' END"),
    ("Content", "Text to HTML ratio", 1, "CASE WHEN ratio >= 10 THEN 'pass' ELSE 'warning' END"),
    ("Content", "Readability", 2, "CASE WHEN flesch >= 60 THEN 'pass' ELSE 'warning' END"),
    ("Content", "Empty content", 5, "CASE WHEN text_length < 50 THEN 'critical' END"),
    ("Images", "Image alt text", 3, "CASE WHEN images = 0 THEN 'info' WHEN images - no_alt >= 0.8 * images THEN 'pass' ELSE 'warning' END"),
    ("Images", "Missing alt attributes", 3, "CASE WHEN no_alt > 0 THEN 'warning' END"),
    ("Images", "Empty alt text", 1, "CASE WHEN empty_alt > 2 THEN 'info' END"),
    ("Images", "Modern image formats", 2, "CASE WHEN images = 0 THEN 'info' WHEN modern > 0 THEN 'pass' ELSE 'warning' END"),
    ("Images", "Lazy loading", 2, "CASE WHEN images = 0 THEN 'info' WHEN 2 * lazy >= images THEN 'pass' ELSE 'warning' END"),
    ("Images", "Image dimensions", 3, "CASE WHEN images = 0 THEN 'info' WHEN unsized > 0 THEN 'warning' ELSE 'pass' END"),
    ("Performance", "Render blocking JavaScript", 3, "CASE WHEN blocking > 0 THEN 'warning' ELSE 'pass' END"),
    ("Performance", "Third party scripts", 2, "CASE WHEN foreign_scripts > 8 THEN 'warning' ELSE 'info' END"),
    ("Performance", "Web fonts", 1, "CASE WHEN fonts > 0 THEN 'info' ELSE 'pass' END"),
    ("Mobile", "Viewport meta tag", 5, "CASE WHEN viewport LIKE '%width=device-width%' THEN 'pass' WHEN viewport <> '' THEN 'warning' ELSE 'critical' END"),
    ("Schema", "Structured data", 4, "CASE WHEN bad_schema > 0 THEN 'critical' WHEN schemas > 0 THEN 'pass' ELSE 'warning' END"),
    ("Internal linking", "Internal link count", 3, "CASE WHEN inner_links >= 3 THEN 'pass' ELSE 'warning' END"),
    ("Internal linking", "No internal links", 4, "CASE WHEN inner_links = 0 THEN 'critical' END"),
    ("Internal linking", "Excessive links", 2, "CASE WHEN inner_links + outer_links > 150 THEN 'warning' END"),
    ("Internal linking", "Empty anchor text", 2, "CASE WHEN empty_anchors > 0 THEN 'warning' END"),
    ("International", "Hreflang detected", 2, "CASE WHEN alternates > 0 THEN 'pass' END"),
    ("International", "Invalid hreflang codes", 3, "CASE WHEN bad_alternates > 0 THEN 'warning' END"),
)
_HEADERS = (("HSTS", "hsts"), ("CSP", "csp"), ("X-Frame-Options", "frame_options"), ("X-Content-Type-Options", "type_options"), ("Referrer-Policy", "referrer_policy"), ("Permissions-Policy", "permissions_policy"))
_CRAWLERS = (("GPTBot", "gptbot"), ("ClaudeBot", "claudebot"), ("PerplexityBot", "perplexitybot"), ("Google-Extended", "google_extended"))
SITE_RULES = (
    ("Technical", "HTTPS", 5, "CASE WHEN https THEN 'pass' ELSE 'critical' END"),
    ("Technical", "robots.txt", 4, "CASE WHEN has_robots THEN 'pass' ELSE 'warning' END"),
    ("Technical", "Robots block", 5, "CASE WHEN blocks_all THEN 'critical' ELSE 'pass' END"),
    ("Technical", "XML sitemap", 4, "CASE WHEN has_sitemap THEN 'pass' ELSE 'warning' END"),
    ("Technical", "Trailing slash", 2, "CASE WHEN slash_ends > 0 AND bare_ends > 0 THEN 'warning' END"),
    ("Technical", "Trailing slash", 1, "CASE WHEN slash_ends = 0 OR bare_ends = 0 THEN 'pass' END"),
    ("Technical", "Duplicate URLs", 3, "CASE WHEN shared_paths > 0 THEN 'warning' END"),
    ("On page", "Duplicate titles", 4, "CASE WHEN shared_titles > 0 THEN 'warning' END"),
    ("On page", "Duplicate descriptions", 3, "CASE WHEN shared_descriptions > 0 THEN 'warning' END"),
    ("Performance", "Compression", 3, "CASE WHEN encoding IN ('gzip', 'br', 'deflate') THEN 'pass' ELSE 'warning' END"),
    ("Performance", "Browser caching", 2, "CASE WHEN cache_control <> '' THEN 'pass' ELSE 'warning' END"),
    ("Performance", "Server response time", 2, "CASE WHEN ms IS NULL THEN 'info' WHEN ms < 600 THEN 'pass' ELSE 'warning' END"),
    ("Mobile", "Responsive design", 3, "CASE WHEN media_queries > 0 THEN 'pass' ELSE 'warning' END"),
    ("International", "HTML language", 2, "CASE WHEN home_lang <> '' THEN 'pass' ELSE 'warning' END"),
    ("Security", "Mixed content", 4, "CASE WHEN https THEN CASE WHEN mixed > 0 THEN 'critical' ELSE 'pass' END END"),
    *[("Security", name, 3, f"CASE WHEN https AND NOT {column} THEN 'warning' END") for name, column in _HEADERS],
    *[("Security", name, 1, f"CASE WHEN https AND {column} THEN 'pass' END") for name, column in _HEADERS],
    *[("AI Search", f"{name} access", 2, f"CASE WHEN {column} THEN 'warning' ELSE 'pass' END") for name, column in _CRAWLERS],
    ("AI Search", "AI readable content", 2, "CASE WHEN home_words >= 300 AND home_headings >= 2 THEN 'pass' ELSE 'warning' END"),
    ("Architecture", "Crawl depth", 3, "CASE WHEN pages > 1 THEN 'pass' ELSE 'warning' END"),
    ("External links", "Nofollow external links", 1, "CASE WHEN nofollow_links > 0 THEN 'info' END"),
    ("External links", "Sponsored links", 1, "CASE WHEN sponsored_links > 0 THEN 'info' END"),
    ("External links", "New tab links without noopener", 2, "CASE WHEN open_tabs > 0 THEN 'warning' END"),
)


def _count(values: Column, keep) -> Column:
    return F.size(F.filter(values, keep)).cast("long")


def page_facts(features: DataFrame, pages: DataFrame, fetched: DataFrame, keywords: DataFrame) -> DataFrame:
    """What PAGE_RULES ask of a page, of page_features, their html, fetched (page_id, status) and
    top_keywords. Only counts and short texts go on."""
    every = lambda pattern, g=0: F.regexp_extract_all("html", F.lit(pattern), F.lit(g))
    meta = lambda name: F.trim(F.regexp_extract("html", rf"(?i)<meta[^>]*name=\"{name}\"[^>]*content=\"([^\"]*)", 1))
    bare = lambda url: F.regexp_replace(url, "/$", "")
    images, anchors, head = every(r"(?i)<img\b[^>]*>"), every(r"(?is)<a\b[^>]*\bhref=.*?</a>"), F.regexp_extract("html", r"(?is)<head[^>]*>(.*?)</head>", 1)
    robots, levels, schemas = F.lower(meta("robots")), F.transform(every(r"(?i)<h([1-6])[\s>]", 1), lambda x: x.cast("int")), every(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    outside = lambda url: url.rlike(r"(?i)^(?:https?:)?//") & ~F.contains(F.lower(url), F.col("site"))
    href = lambda a: F.regexp_extract(a, r"(?i)\bhref=[\"']([^\"']*)", 1)
    outer, alternates = F.filter(anchors, lambda a: outside(href(a))), every(r"(?i)<link[^>]*hreflang=\"([^\"]*)\"", 1)
    rel = lambda a, word: a.rlike(rf"(?i)\brel=[\"'][^\"']*{word}")
    has = lambda pattern: (lambda x: x.rlike(pattern))
    lacks = lambda pattern: (lambda x: ~x.rlike(pattern))
    w = tx.words(F.col("main_text"))
    rows = features.select("page_id", "site", "url", "path", "scheme", "title", "lang", "h1", "noindex", "canonical", "main_text", "visible_text", "html_bytes", "word_count").join(pages.select("page_id", "html"), "page_id").join(fetched.select("page_id", "status"), "page_id")
    rows = rows.join(keywords.where("rank = 1").select("page_id", F.col("word").alias("keyword"), F.col("uses").alias("keyword_uses")), "page_id", "left")
    named = lambda text: F.coalesce(F.array_contains(tx.words(F.lower(text)), F.col("keyword")), F.lit(False))
    return rows.select(
        "page_id", "site", "url", "path", "scheme", "status", "title", "lang", (F.col("noindex") | robots.contains("noindex")).alias("noindex"), robots.contains("nofollow").alias("nofollow"), meta("description").alias("description"),
        bare(F.col("canonical")).alias("canonical"), bare(F.col("url")).alias("own_url"), F.contains("canonical", F.col("site")).alias("own_canonical"),
        _count(levels, lambda x: x == 1).alias("h1s"), _count(levels, lambda x: x == 2).alias("h2s"), F.size(levels).cast("long").alias("headings"), pf.heading_skips(levels).alias("skips"),
        F.coalesce("keyword_uses", F.lit(0)).alias("keyword_uses"), named(F.col("title")).alias("keyword_in_title"), named(F.col("h1")).alias("keyword_in_h1"),
        F.col("word_count").cast("long").alias("words"), tx.half_up(100.0 * F.octet_length("visible_text") / F.greatest(F.lit(1), F.col("html_bytes"))).alias("ratio"), F.length("main_text").alias("text_length"),
        F.coalesce(tx.flesch(F.size(w).cast("double"), F.size(tx.sentences(F.col("main_text"))).cast("double"), tx.syllable_count(w).cast("double")), F.lit(0.0)).alias("flesch"),
        F.size(images).cast("long").alias("images"), _count(images, lacks(r"(?i)\balt\s*=")).alias("no_alt"), _count(images, has(r"(?i)\balt\s*=\s*(?:\"\"|'')")).alias("empty_alt"), _count(images, has(r"(?i)\bsrc=[\"'][^\"']*\.(?:webp|avif)")).alias("modern"),
        _count(images, has(r"(?i)\bloading=[\"']lazy")).alias("lazy"), _count(images, lambda x: ~x.rlike(r"(?i)\bwidth\s*=") | ~x.rlike(r"(?i)\bheight\s*=")).alias("unsized"),
        _count(F.regexp_extract_all(head, F.lit(r"(?i)<script\b[^>]*\bsrc=[^>]*>"), F.lit(0)), lacks(r"(?i)\b(?:async|defer)\b")).alias("blocking"), _count(F.array_distinct(every(r"(?i)<script\b[^>]*?\bsrc=[\"']([^\"']*)", 1)), outside).alias("foreign_scripts"),
        F.size(every(r"(?i)fonts\.(?:googleapis|gstatic)|@font-face")).cast("long").alias("fonts"), meta("viewport").alias("viewport"), F.size(schemas).cast("long").alias("schemas"), _count(schemas, lambda x: F.try_parse_json(x).isNull()).alias("bad_schema"),
        _count(anchors, lambda a: ~outside(href(a)) & ~href(a).rlike("(?i)^(?:#|mailto:|tel:|javascript:)")).alias("inner_links"), F.size(outer).cast("long").alias("outer_links"), _count(anchors, lambda a: ~outside(href(a)) & (tx.plain(a) == "") & ~a.rlike("(?i)<img")).alias("empty_anchors"),
        F.size(alternates).cast("long").alias("alternates"), _count(alternates, lacks("^(?:[a-z]{2,3}(?:-[A-Za-z0-9]+)?|x-default)$")).alias("bad_alternates"), F.size(every("(?i)@media")).cast("long").alias("media_queries"),
        F.size(every(r"(?i)<(?:img|script)\b[^>]*\bsrc=[\"']http://|<link\b[^>]*stylesheet[^>]*\bhref=[\"']http://")).cast("long").alias("mixed"),
        _count(outer, lambda a: rel(a, "nofollow")).alias("nofollow_links"), _count(anchors, lambda a: rel(a, "sponsored")).alias("sponsored_links"), _count(outer, lambda a: a.rlike(r"(?i)\btarget=[\"']_blank") & ~rel(a, "(?:noopener|noreferrer)")).alias("open_tabs"),
    )


def site_facts(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """What SITE_RULES ask of a site, of page_facts and fetched, a row a site of its first answer and robots
    file; its home is the page with the shortest path, the least page_id among equals."""
    c = F.col
    home = lambda x: F.min_by(x, F.struct(F.length("path"), "page_id"))
    tail = c("path").endswith("/")
    sums = pages.groupBy("site").agg(
        F.count("*").alias("pages"), home(c("scheme") == "https").alias("https"), home("lang").alias("home_lang"), home("words").alias("home_words"), home("headings").alias("home_headings"), home("media_queries").alias("media_queries"),
        F.count_if(tail & (c("path") != "/")).alias("slash_ends"), F.count_if(~tail & (c("path") != "")).alias("bare_ends"), *[F.sum(n).alias(n) for n in ("mixed", "nofollow_links", "sponsored_links", "open_tabs")],
    )
    names = {"path": "shared_paths", "title": "shared_titles", "description": "shared_descriptions"}
    values = pages.select("site", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c(k).alias("value")) for k, n in names.items()])).alias("v")).select("site", "v.*").where("value <> ''")
    twice = values.groupBy("site", "kind", "value").agg(F.count("*").alias("n")).where("n > 1").groupBy("site").agg(*[F.count_if(c("kind") == n).alias(n) for n in names.values()])
    return sums.join(twice, "site", "left").fillna(0, [*names.values()]).join(fetched, "site")


def checked(facts: DataFrame, rules: tuple[tuple[str, str, int, str], ...], *keys: str) -> DataFrame:
    """(keys, grp, check, weight, status): what each rule says of each row, in long form."""
    row = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("check"), F.lit(w).alias("weight"), F.expr(s).alias("status")) for g, c, w, s in rules])
    return facts.select(*keys, F.inline(row)).where("status is not null")


def audit_scores(found: DataFrame) -> DataFrame:
    """(site, grp, checks, score, grade): the weighted mean of 100 for passed, 60 for warned and 0 for critical
    checks, per group and, with grp null, in all; info says nothing."""
    value = F.when(F.col("status") == "pass", 100).when(F.col("status") == "warning", 60).otherwise(0)
    kept = found.where("status <> 'info'").select("site", "grp", "weight", value.alias("value"))
    sums = kept.rollup("site", "grp").agg(F.count("*").alias("checks"), tx.half_up(F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("score")).where("site is not null")
    return sums.select("site", "grp", "checks", "score", F.expr(GRADE).alias("grade"))
