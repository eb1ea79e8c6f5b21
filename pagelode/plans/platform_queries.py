"""Queries on platforms, themes, script-heavy pages and item categories; what pages lack follows from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.functions import urls
from pagelode.operators import feed_parts as fp
from pagelode.operators import reports as rp
from pagelode.operators import wordpress as wp
from pagelode.plans import duck as d
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: What a page of each kind shows: markup, X-Pingback, feed, robots file, REST answer.
KINDS = (
    ('<meta name="generator" content="WordPress 6.4"><link rel="stylesheet" id="kid-css" href="/wp-content/themes/kid/style.css"><script src="/wp-includes/x.js"></script><a href="/wp-json/">', "", "", "", ""), ('<div class="wp-block-x"><img class="wp-image-7" src="/wp-content/uploads/i.png">', "u", "", "Disallow: /wp-admin/ Allow: /wp-content/", ""),
    ("<p>plain</p>", "", "", "", '{"namespaces": ["wp/v2"]}'), ("<a href='/wp-login.php'>", "", "", "", '{"namespaces": ["x"]}'), ("", "", "<generator>https://wordpress.org/?v=6</generator>", "", ""), ("", "", "", "", ""),
    ('<script src="/wp-content/themes/a/x.js"></script><link rel="stylesheet" href="/wp-content/themes/b/y.css"> /wp-content/themes/a/', "", "", "", "/wp-content/themes/b/"),
)


def _kind(k: int) -> str:
    return f"CASE page_id % {len(KINDS)} {' '.join(f'WHEN {n} THEN {_text(x[k])}' for n, x in enumerate(KINDS))} END"


def built(spark: SparkSession, sf: str) -> DataFrame:
    """A site for each page."""
    return read_table(spark, sf, "pages").select(
        F.col("page_id").alias("site"), F.concat("html", F.expr(_kind(0))).alias("html"), F.create_map(F.lit("x-pingback"), F.nullif(F.expr(_kind(1)), F.lit(""))).alias("headers"),
        *[F.nullif(F.expr(_kind(k)), F.lit("")).alias(c) for k, c in ((2, "feed"), (3, "robots"), (4, "rest"))], F.lit(None).cast("string").alias("loaded"),
    )


_BUILT = f"b AS (SELECT page_id AS site, html || {_kind(0)} AS html, {_kind(1)} AS pingback, {_kind(2)} AS feed, {_kind(3)} AS robots, {_kind(4)} AS rest, '' AS loaded FROM pages), c AS (SELECT *, array_to_string(regexp_extract_all(html, {_text(wp._GENERATOR)}, 1), chr(10)) AS generators FROM b)"
_SIGNAL = " UNION ALL ".join(f"SELECT site, '{f}' AS family, '{k}' AS key, {w} AS weight FROM c WHERE " + " AND ".join(f"regexp_matches({c}, {_text(p)})" for p in pattern.split(" && ")) for f, k, w, c, pattern in wp.SIGNALS)
_NAMED = " + ".join(f"regexp_matches(robots, '(?i){p}')::INT" for p in wp.ROBOTS)


@query(f"""WITH {_BUILT}, s AS ({_SIGNAL} UNION ALL SELECT site, 'robots', 'robots_wp_paths', {wp.ROBOTS_WEIGHT} FROM c WHERE {_NAMED} >= 2
 UNION ALL SELECT site, 'rest', 'rest_probe_generic', {wp.OTHER_REST} FROM c WHERE contains(rest, '"namespaces":') AND NOT contains(rest, 'wp/v2')),
t AS (SELECT c.site, count(DISTINCT family) AS n, CAST(coalesce(sum(weight), 0) AS BIGINT) AS s, coalesce(bool_or(key IN ('rest_probe', 'generator', 'browser_asset_load')), false) AS alone, coalesce(bool_or(key = 'rest_probe'), false) AS rest FROM c LEFT JOIN s ON s.site = c.site GROUP BY c.site)
SELECT site, CAST(n AS INTEGER) AS families, CAST(s AS INTEGER) AS score, CASE WHEN (n >= 3 AND s >= 60) OR (n >= 2 AND s >= 30) OR (n = 1 AND alone AND s >= 30) THEN 'detected' WHEN n >= 1 AND s >= 15 THEN 'likely' ELSE 'not_detected' END AS status,
 CAST(CASE WHEN n >= 3 AND s >= 60 THEN least(99, greatest(85, floor(55 + s * 0.42 + 0.5))) WHEN n >= 2 AND s >= 30 THEN least(88, greatest(70, floor(45 + s * 0.5 + 0.5))) WHEN n = 1 AND alone AND s >= 30 THEN CASE WHEN rest THEN 88 ELSE 83 END
 WHEN n >= 1 AND s >= 15 THEN least(68, greatest(40, floor(38 + s * 0.4 + 0.5))) WHEN s > 0 THEN 92 ELSE 98 END AS INTEGER) AS confidence FROM t""")
def wordpress_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return wp.verdicts(built(spark, sf)).drop("signals")


@query("""SELECT page_id AS site, CAST(r AS INTEGER) AS rank, slug, score FROM pages JOIN (VALUES (0, 1, 'kid', 62), (6, 1, 'b', 19), (6, 2, 'a', 10)) AS t(k, r, slug, score) ON page_id % 7 = k""")
def theme_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return wp.theme_candidates(built(spark, sf)).select("site", "rank", "slug", "score")


@query(f"""WITH {d.MAIN} SELECT page_id, len({d.words('main')}) < 40 AND length(html) * 60 > 25000 AND (len(regexp_extract_all(html, '(?i)<script\\b[^>]*src=')) + page_id % 9 >= 8 OR len(regexp_extract_all(html, '(?i)<script>')) + page_id % 7 >= 6) AS js_heavy FROM f""")
def js_heavy_pages(spark: SparkSession, sf: str) -> DataFrame:
    """W10 on pages sixty times as long and with more scripts, by their numbers, than those given."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    heavy = rp.js_heavy(F.size(tx.words(tx.main_text(F.col("html")))), F.length("html") * 60, n(r"(?i)<script\b[^>]*src=") + F.col("page_id") % 9, n("(?i)<script>") + F.col("page_id") % 7)
    return read_table(spark, sf, "pages").select("page_id", heavy.alias("js_heavy"))


@query(f"""WITH {d.PAGE}, s AS (SELECT page_id, [x for x in string_split(path, '/') if x <> ''] AS c, CASE WHEN page_id % 3 = 0 THEN 'Sport' ELSE '' END AS section FROM h),
a AS (SELECT page_id, section, CASE WHEN len(c) >= 2 THEN c[len(c) - 1] END AS up FROM s), b AS (SELECT page_id, section, CASE WHEN NOT regexp_matches(up, '{fp.NO_CATEGORY}') AND length(up) <= {fp.LONGEST} THEN up END AS up FROM a)
SELECT page_id, array_to_string([x for x in [nullif(section, ''), up] if x IS NOT NULL], ',') AS categories, CASE page_id % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/ogg' END AS audio FROM b""")
def item_categories(spark: SparkSession, sf: str) -> DataFrame:
    crumbs = F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != "")
    section = F.when(F.col("page_id") % 3 == 0, "Sport").otherwise("")
    audio = F.expr("CASE page_id % 4 WHEN 0 THEN 'https://a.example/x.MP3?y' WHEN 1 THEN 'x.oga#t' WHEN 2 THEN 'x.png' ELSE 'mp3' END")
    return read_table(spark, sf, "pages").select("page_id", F.array_join(fp.item_categories(section, crumbs), ",").alias("categories"), fp.audio_type(audio).alias("audio"))
