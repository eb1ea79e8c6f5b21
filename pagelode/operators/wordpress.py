"""Whether a site runs WordPress, and which theme it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx

_ASSET = r"""(?i)\b(?:src|href)\s*=\s*["'][^"']*"""
#: Family, signal, weight, column and pattern; two patterns parted by ` && ` have to hold both.
SIGNALS = (
    ("assets", "wp_includes", 25, "html", _ASSET + "/wp-includes/"), ("assets", "wp_content_themes", 15, "html", _ASSET + "/wp-content/themes/"), ("assets", "wp_content_plugins", 8, "html", _ASSET + "/wp-content/plugins/"),
    ("assets", "wp_content_uploads", 6, "html", _ASSET + "/wp-content/uploads/"), ("assets", "wp_emoji", 12, "html", r"(?i)wp-emoji-release\.min\.js"), ("html", "wp_block_classes", 10, "html", r"(?i)\bwp-block-"), ("html", "wp_image_classes", 6, "html", r"(?i)\bwp-image-\d|wp-caption\b"),
    ("rest", "rest_reference", 15, "html", "(?i)wp-json|wpApiSettings|rest_route="), ("html", "wp_hooks", 6, "html", "(?i)wpautop|wp_footer|wp_body_open"), ("meta", "generator", 30, "generators", r"(?i)\bwordpress\b"),
    ("headers", "pingback", 8, "pingback", "."), ("headers", "shortlink", 6, "html", r"""(?i)rel\s*=\s*["']?shortlink && \?p=\d+"""), ("feeds", "feed_generator", 15, "feed", r"""(?i)<generator[^>]*>[^<]*wordpress|<!--\s*generator="[^"]*wordpress"""),
    ("login", "wp_login_ref", 6, "html", r"(?i)wp-login\.php"), ("login", "xmlrpc_ref", 4, "html", r"(?i)xmlrpc\.php"), ("rest", "rest_probe", 30, "rest", r'"namespaces"\s*:\s*\[[^\]]*"wp/v2"'), ("assets", "browser_asset_load", 30, "loaded", "."),
)
#: Signals that settle it alone, paths of which a robots file names two at least, and its weight; points
#: of a REST answer with other namespaces.
ALONE, ROBOTS, ROBOTS_WEIGHT, OTHER_REST = ("rest_probe", "generator", "browser_asset_load"), ("wp-admin", "wp-content", "wp-includes", r"wp-login\.php"), 6, 12
_GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']*)["']"""
_SLUG = r"/wp-content/themes/([A-Za-z0-9_.-]+)/"


def verdicts(sites: DataFrame) -> DataFrame:
    """(site, signals, families, score, status, confidence) of sites (site, html, headers, feed, robots, rest,
    loaded): headers by lower-case name, the text of feed, robots file and REST answer where there are any,
    the core file that a browser could load."""
    rows = sites.withColumns({
        "generators": F.array_join(F.regexp_extract_all("html", F.lit(_GENERATOR), F.lit(1)), "\n"), "pingback": F.coalesce(F.try_element_at("headers", F.lit("x-pingback")), F.try_element_at("headers", F.lit("pingback"))),
    })
    signal = lambda family, key, weight, holds: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(family).alias("family"), F.lit(key).alias("key"), F.lit(weight).alias("weight")))

    def holds(column: str, pattern: str) -> Column:
        first, *others = [F.col(column).rlike(p) for p in pattern.split(" && ")]
        for other in others:
            first = first & other
        return first

    named = sum((F.coalesce(F.col("robots").rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in ROBOTS), F.lit(0))
    other_rest = F.col("rest").rlike(r'"namespaces"\s*:') & ~holds("rest", SIGNALS[15][4])
    found = F.array_compact(F.array(*[signal(f, k, w, holds(c, p)) for f, k, w, c, p in SIGNALS], signal("robots", "robots_wp_paths", ROBOTS_WEIGHT, named >= 2), signal("rest", "rest_probe_generic", OTHER_REST, other_rest)))
    rows = rows.withColumn("signals", found)
    score = F.aggregate("signals", F.lit(0), lambda a, s: a + s["weight"])
    families, alone = F.size(F.array_distinct(F.transform("signals", lambda s: s["family"]))), F.exists("signals", lambda s: s["key"].isin(*ALONE))
    rows = rows.withColumns({"score": score, "families": families, "alone": alone})
    s, n = F.col("score"), F.col("families")
    level = lambda base, by, low, high: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), tx.half_up(base + s * by)))
    sure, two, one, likely = (n >= 3) & (s >= 60), (n >= 2) & (s >= 30), (n == 1) & F.col("alone") & (s >= 30), (n >= 1) & (s >= 15)
    rest = F.exists("signals", lambda x: x["key"] == "rest_probe")
    status = F.when(sure | two | one, "detected").when(likely, "likely").otherwise("not_detected")
    confidence = F.when(sure, level(55, 0.42, 85, 99)).when(two, level(45, 0.5, 70, 88)).when(one, F.when(rest, 88.0).otherwise(83.0)).when(likely, level(38, 0.4, 40, 68)).when(s > 0, 92.0).otherwise(98.0)
    return rows.select("site", F.transform("signals", lambda x: x["key"]).alias("signals"), n.alias("families"), s.alias("score"), status.alias("status"), confidence.cast("int").alias("confidence"))


def theme_candidates(sites: DataFrame) -> DataFrame:
    """(site, rank, slug, score, references) of sites (site, html, rest): themes that the markup names, by
    stylesheet, script and mere references; of equal scores the one named first."""
    clean = F.replace("html", F.lit("\\/"), F.lit("/"))
    slugs = lambda text: F.regexp_extract_all(text, F.lit(_SLUG), F.lit(1))
    slug_of = lambda text: F.regexp_extract(text, _SLUG, 1)
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    of = lambda t, name: F.regexp_extract(t, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    at = lambda text, slug: F.instr(text, F.concat(F.lit("/wp-content/themes/"), slug, F.lit("/")))
    named = sites.select("site", clean.alias("text"), F.explode(slugs(clean)).alias("slug")).groupBy("site", "slug").agg(F.count("*").alias("refs"), F.min(at(F.col("text"), F.col("slug"))).alias("first"))
    linked = sites.select("site", F.explode(tags(r"(?is)<link\b[^>]*>")).alias("t")).where(of(F.col("t"), "rel").rlike("(?i)stylesheet")).select("site", slug_of(of(F.col("t"), "href")).alias("slug"), of(F.col("t"), "href").alias("href"), of(F.col("t"), "id").alias("id")).where("slug <> ''")
    handle = F.lower("id").rlike("-css$") & (F.regexp_replace(F.lower("id"), "(-style-css|-css-css|-css)$", "").isin("") | F.endswith(F.concat(F.lit("-"), F.regexp_replace(F.lower("id"), "(-style-css|-css-css|-css)$", "")), F.concat(F.lit("-"), F.lower("slug"))))
    styles = linked.groupBy("site", "slug").agg(F.bool_or(F.col("href").rlike(r"(?i)/style\.css(\?|$)") | handle).alias("main"))
    scripts = sites.select("site", F.explode(tags(r"(?is)<script\b[^>]*>")).alias("t")).select("site", slug_of(of(F.col("t"), "src")).alias("slug")).where("slug <> ''").distinct().withColumn("script", F.lit(True))
    told = sites.select("site", F.explode(slugs(F.replace("rest", F.lit("\\/"), F.lit("/")))).alias("slug")).groupBy("site", "slug").agg(F.count("*").alias("told"))
    rows = named.join(styles, ["site", "slug"], "full").join(scripts, ["site", "slug"], "full").join(told, ["site", "slug"], "full")
    points = F.when(F.col("main"), 45).otherwise(0) + F.when(F.col("main").isNotNull(), 15).otherwise(0) + F.when(F.col("script"), 6).otherwise(0) + 2 * F.least(F.coalesce("refs", F.lit(0)), F.lit(12)) + 2 * F.least(F.coalesce("told", F.lit(0)), F.lit(6))
    scored = rows.withColumn("score", points.cast("int"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), F.asc_nulls_last("first"), "slug"))
    return scored.select("site", rank.alias("rank"), "slug", "score", F.coalesce("refs", F.lit(0)).alias("references"))
