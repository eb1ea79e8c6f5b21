"""Technologies by many patterns against many pages.

A pattern on a page's markup can't match unless the page holds the literal that the pattern requires, so
one pass looks for all literals at once, and only those found lead to their patterns by an equi-join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Technology, category, where it shows, header or required literals in lower case (one of them,
#: parted by a bar), pattern, weight; patterns ignore case.
TESTS = (
    ("WordPress", "CMS", "html", "wp-content/|wp-includes/", r"wp-content/|wp-includes/", 3.0), ("WordPress", "CMS", "meta", "wordpress", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*WordPress[^"']*["']""", 3.0),
    ("WordPress", "CMS", "header", "x-pingback", "x-pingback", 1.0), ("WordPress", "CMS", "html", "wp-json/", "wp-json/", 1.0), ("WordPress", "CMS", "path", "/wp-json/", "", 2.0),
    ("Shopify", "E-commerce", "html", "cdn.shopify.com|shopifycdn", r"cdn\.shopify\.com|shopifycdn", 3.0), ("Shopify", "E-commerce", "meta", "shopify", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Shopify""", 3.0),
    ("Shopify", "E-commerce", "header", "x-shopid", ".+", 3.0), ("Shopify", "E-commerce", "html", "myshopify.com", r"myshopify\.com", 2.0),
    ("Wix", "Site builder", "html", "wixstatic.com", r"wixstatic\.com|static\.wixstatic\.com", 3.0), ("Wix", "Site builder", "meta", "wix", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Wix""", 3.0),
    ("Wix", "Site builder", "header", "x-wix-request-id", ".+", 2.0), ("Wix", "Site builder", "html", "_wixabtests|wix-code", "_wixABTests|wix-code", 1.0),
    ("Webflow", "Site builder", "meta", "webflow", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Webflow""", 3.0), ("Webflow", "Site builder", "html", "webflow.io|website-files.com", r"webflow\.io|assets\.website-files\.com", 3.0), ("Webflow", "Site builder", "header", "x-powered-by", "webflow", 2.0),
    ("Drupal", "CMS", "meta", "drupal", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Drupal[^"']*""", 3.0), ("Drupal", "CMS", "header", "x-generator", "Drupal", 3.0), ("Drupal", "CMS", "header", "x-drupal-cache", ".+", 3.0), ("Drupal", "CMS", "html", "/sites/", "/sites/(default|all)/files/", 2.0),
    ("Joomla", "CMS", "meta", "joomla", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Joomla""", 3.0), ("Joomla", "CMS", "html", "/media/system/js/", "/media/system/js/", 2.0), ("Joomla", "CMS", "html", "com_content", "com_content", 1.0),
    ("Laravel (PHP)", "Framework", "cookie", "laravel_session", "laravel_session", 3.0), ("Laravel (PHP)", "Framework", "header", "x-powered-by", "laravel", 1.0),
    ("Next.js (React)", "Framework", "html", "/_next/static/", "/_next/static/", 3.0), ("Next.js (React)", "Framework", "html", "__next", r"""<div id=["']__next["']>""", 2.0), ("Next.js (React)", "Framework", "html", "__next_data__", "__NEXT_DATA__", 3.0),
    ("Nuxt.js (Vue)", "Framework", "html", "/_nuxt/", "/_nuxt/", 3.0), ("Nuxt.js (Vue)", "Framework", "html", "window.__nuxt__", r"window\.__NUXT__", 3.0),
    ("React", "Framework", "html", "react", r"react(-dom)?(\.production)?\.min\.js", 2.0), ("React", "Framework", "html", "data-reactroot", "data-reactroot", 2.0),
    ("Vue.js", "Framework", "html", "vue", r"vue(\.runtime)?(\.global)?(\.prod)?\.js", 2.0), ("Vue.js", "Framework", "html", "data-v-", "data-v-[0-9a-f]{6,8}", 2.0),
    ("Angular", "Framework", "html", "ng-version=", "ng-version=", 3.0), ("Angular", "Framework", "html", "angular", r"angular(\.min)?\.js", 2.0), ("jQuery", "Library", "html", "jquery", r"jquery[.-]([0-9.]+)(\.min)?\.js", 2.0),
    ("PHP", "Language", "header", "x-powered-by", "^php/", 3.0), ("PHP", "Language", "html", ".php", r"""\.php(?:["'?]|$)""", 1.0), ("Node.js", "Language", "header", "x-powered-by", "express", 2.0), ("Node.js", "Language", "header", "server", r"node\.js", 2.0),
    ("Cloudflare", "CDN / Proxy", "header", "server", "cloudflare", 3.0), ("Cloudflare", "CDN / Proxy", "header", "cf-ray", ".+", 3.0),
    ("Google Tag Manager", "Analytics", "html", "googletagmanager.com/gtm.js", r"googletagmanager\.com/gtm\.js\?id=GTM-[A-Z0-9]+", 3.0), ("Google Tag Manager", "Analytics", "html", "datalayer", r"dataLayer\s*=\s*dataLayer", 1.0),
    ("Google Analytics (GA4)", "Analytics", "html", "googletagmanager.com/gtag/js", r"googletagmanager\.com/gtag/js\?id=G-[A-Z0-9]+", 3.0), ("Google Analytics (GA4)", "Analytics", "html", "gtag(", r"""gtag\(["']config["'],\s*["']G-[A-Z0-9]+""", 3.0), ("Google Analytics (GA4)", "Analytics", "html", "google-analytics.com/analytics.js", r"google-analytics\.com/analytics\.js", 1.0),
    ("LiteSpeed", "Web server", "header", "server", "litespeed", 3.0), ("LiteSpeed", "Web server", "header", "x-litespeed-cache", ".+", 3.0), ("LiteSpeed", "Web server", "header", "x-lsadc-cache", ".+", 2.0),
    ("Nginx", "Web server", "header", "server", "^nginx(/|$)", 3.0), ("Apache", "Web server", "header", "server", "^apache(/|$)", 3.0), ("Amazon CloudFront", "CDN / Proxy", "header", "x-amz-cf-id", ".+", 3.0), ("Amazon CloudFront", "CDN / Proxy", "header", "server", "cloudfront", 3.0),
    ("Hugo", "Static site generator", "meta", "hugo", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Hugo[^"']*""", 3.0), ("Gatsby", "Static site generator", "html", "___gatsby", 'id="___gatsby"', 3.0), ("Gatsby", "Static site generator", "html", "/page-data/", r"/page-data/app-data\.json", 2.0),
    ("Jekyll", "Static site generator", "meta", "jekyll", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Jekyll[^"']*""", 3.0), ("Elementor", "WordPress page builder", "html", "/wp-content/plugins/elementor/", "/wp-content/plugins/elementor/", 3.0), ("Elementor", "WordPress page builder", "html", "elementor-widget-", "elementor-widget-", 2.0),
    ("Squarespace", "Site builder", "html", "static1.squarespace.com|squarespace-cdn.com", r"static1\.squarespace\.com|squarespace-cdn\.com", 3.0), ("Squarespace", "Site builder", "header", "server", "squarespace", 2.0), ("Ghost", "CMS", "meta", "ghost", r"""<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*Ghost[^"']*""", 3.0),
    ("Netlify", "Hosting platform", "header", "server", "netlify", 3.0), ("Netlify", "Hosting platform", "html", "netlify-cdn|netlifyglobalcdn", "netlify-cdn|netlifyglobalcdn", 2.0), ("Vercel", "Hosting platform", "header", "x-vercel-id", ".+", 3.0), ("Vercel", "Hosting platform", "header", "x-vercel-cache", ".+", 2.0),
)
#: Evidence that a technology takes, and from which confidence it is detected, not likely.
LEAST_SCORE, DETECTED = 2.5, 75
_GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["'][^"']*["']"""


def tests_table(spark: SparkSession, tests=TESTS) -> DataFrame:
    """(test, technology, category, kind, literal, pattern, weight): a row for each literal of a test."""
    rows = [(k, tech, category, kind, x, f"(?i){pattern}", weight) for k, (tech, category, kind, literals, pattern, weight) in enumerate(tests) for x in literals.split("|")]
    return spark.createDataFrame(rows, "test int, technology string, category string, kind string, literal string, pattern string, weight double")


def held_literals(text: Column, literals: list[str]) -> Column:
    """The literals that a text holds, in one pass: at each place the longest, and those that begin it."""
    longest = sorted(set(literals), key=lambda x: (-len(x), x))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({'|'.join(map(re.escape, longest))}))"), F.lit(1)))
    begun = [(x, [y for y in longest if x != y and x.startswith(y)]) for x in longest]
    more = [F.when(F.array_contains(found, x), F.array(*map(F.lit, ys))).otherwise(F.array().cast("array<string>")) for x, ys in begun if ys]
    return F.array_distinct(F.flatten(F.array(found, *more)))


def detected(pages: DataFrame, tests=TESTS) -> DataFrame:
    """(page_id, technology, category, score, confidence, status) of pages (page_id, html, headers, cookies,
    paths): headers by lower-case name, the status of known paths that were asked for."""
    rules = tests_table(pages.sparkSession, tests)
    kinds = {kind: [x for t in tests if t[2] == kind for x in t[3].split("|")] for kind in ("html", "meta", "cookie")}
    meta = F.array_join(F.regexp_extract_all("html", F.lit(_GENERATOR), F.lit(0)), " ")
    sources = {"html": F.col("html"), "meta": meta, "cookie": F.col("cookies")}
    hits = None
    for kind, source in sources.items():
        if kinds[kind]:
            own = pages.select("page_id", F.lit(kind).alias("kind"), source.alias("value")).where("value <> ''").withColumn("literal", F.explode(held_literals(F.col("value"), kinds[kind])))
            hits = own if hits is None else hits.unionByName(own)
    headers = pages.select("page_id", F.lit("header").alias("kind"), F.explode("headers").alias("literal", "value")).select("page_id", "kind", "value", F.lower("literal").alias("literal"))
    paths = pages.select("page_id", F.lit("path").alias("kind"), F.explode("paths").alias("literal", "status")).where("status > 0 and status < 400").select("page_id", "kind", F.lit("").alias("value"), "literal")
    hits = headers.unionByName(paths) if hits is None else hits.unionByName(headers).unionByName(paths)
    met = hits.join(rules, ["kind", "literal"]).where("value rlike pattern").select("page_id", "test", "technology", "category", "weight").distinct()
    scored = met.groupBy("page_id", "technology", "category").agg(F.sum("weight").alias("score")).where(F.col("score") >= LEAST_SCORE)
    confidence = F.floor(F.least(F.lit(96.0), 40 + 12 * F.col("score")) + 0.5)
    return scored.select("page_id", "technology", "category", "score", confidence.alias("confidence"), F.when(confidence >= DETECTED, "detected").otherwise("likely").alias("status"))
