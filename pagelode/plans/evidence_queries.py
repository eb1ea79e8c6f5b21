"""Queries on technologies, inlinks, important pages, feeds, languages, requirements and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import pages as pg
from pagelode.operators import site_evidence as se
from pagelode.operators import technology as te
from pagelode.plans import duck as d
from pagelode.plans import site_queries as sq
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


#: What a page's builder leaves in its markup, its answer's headers and its cookies, by page number; none by
#: default. {n} is the page number.
BUILT = (
    ('<meta name="generator" content="WordPress 6.4"><link href="/wp-content/a.css">', "server", "nginx/1.25", ""), ("<script src=/_next/static/x.js></script>", "x-vercel-id", "fra1::x", ""), ("", "server", "cloudflare", "laravel_session=x"),
    ('<script src="https://cdn.shopify.com/x.js"></script>', "server", "apache", ""), ("<p>WordPress, Drupal, com_content</p>", "via", "1.1 proxy", ""), ('<script src="jquery-3.7.1.min.js"></script><b data-reactroot>', "x-powered-by", "PHP/8.2", ""), ("", "", "", ""),
)


def _built(k: int) -> str:
    return f"CASE page_id % {len(BUILT)} {' '.join(f'WHEN {n} THEN {_text(b[k])}' for n, b in enumerate(BUILT))} END"


@query(f"""WITH p AS (SELECT page_id, html || {_built(0)} AS html, {_built(1)} AS hn, {_built(2)} AS hv, {_built(3)} AS cookies FROM pages),
r AS (SELECT * FROM (VALUES {', '.join(f"({k}, {_text(t[0])}, {_text(t[1])}, '{t[2]}', {_text(t[3])}, {_text('(?i)' + t[4])}, {t[5]})" for k, t in enumerate(te.TESTS))}) AS t(test, technology, category, kind, literal, pattern, weight)),
m AS (SELECT page_id, technology, category, weight FROM p JOIN r ON CASE kind WHEN 'html' THEN regexp_matches(html, pattern) WHEN 'meta' THEN regexp_matches(html, pattern) WHEN 'cookie' THEN regexp_matches(cookies, pattern) WHEN 'header' THEN hn = literal AND regexp_matches(hv, pattern) ELSE false END),
s AS (SELECT page_id, technology, category, CAST(sum(weight) AS DOUBLE) AS score FROM m GROUP BY ALL HAVING sum(weight) >= {te.LEAST_SCORE})
SELECT *, CAST(floor(least(96, 40 + 12 * score) + 0.5) AS BIGINT) AS confidence, CASE WHEN floor(least(96, 40 + 12 * score) + 0.5) >= {te.DETECTED} THEN 'detected' ELSE 'likely' END AS status FROM s""")
def technologies(spark: SparkSession, sf: str) -> DataFrame:
    built = read_table(spark, sf, "pages").select(
        "page_id", F.concat("html", F.expr(_built(0))).alias("html"), F.create_map(F.expr(_built(1)), F.expr(_built(2))).alias("headers"), F.expr(_built(3)).alias("cookies"), F.lit(None).cast("map<string, int>").alias("paths"),
    )
    return te.detected(built)


_LK = f"""{sq._LINKS}, fr AS (SELECT page_id, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) AS frame FROM h),
li AS (SELECT lk.site, lk.page_id, key, text, {d.site('target')} = lk.site AS internal, contains(frame, '"' || href || '"') AS nav FROM lk JOIN fr USING (page_id))"""


@query(f"""WITH {_LK} SELECT site, key, count(*) AS inlinks, count(DISTINCT page_id) AS sources, bool_or(nav) AS nav_linked, coalesce(array_to_string(list_sort(list_distinct(list(lower(trim(text))) FILTER (nav AND trim(text) <> ''))), '|'), '') AS nav_labels FROM li WHERE internal GROUP BY site, key""")
def inlink_signals(spark: SparkSession, sf: str) -> DataFrame:
    return se.inlink_signals(sq.links(spark, sf)).withColumn("nav_labels", F.array_join("nav_labels", "|"))


#: A word of its role for a page, by page number, as its title ends and as pages of its site link it.
ROLE_WORD = "CASE page_id % 9 WHEN 0 THEN 'About the company' WHEN 1 THEN 'Contact' WHEN 2 THEN 'Privacy' WHEN 3 THEN 'Learn more' ELSE '' END"
_ROLE_ROWS = ", ".join(f"('{role}', {k}, {_text(p)})" for role, ps in se.ROLES for k, p in enumerate(ps))


@query(f"""WITH {_LK}, {d.EDGES.removeprefix(d.PAGE + ",")}, f AS (SELECT page_id, site, scheme || '://' || site || regexp_replace(path, '/+$', '') || {d.kept_query('query')} AS key, lower(path || ' ' || {d.plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} || ' ' || {ROLE_WORD} || ' ' || {d.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) AS strong,
 lower(left({d.visible('html')}, {se.BODY})) AS weak FROM h), ro AS (SELECT * FROM (VALUES {_ROLE_ROWS}) AS t(role, k, pattern)),
ow AS (SELECT site, page_id, key, role, sum(CASE WHEN regexp_matches(strong, pattern) THEN {se.STRONG} WHEN regexp_matches(weak, pattern) THEN {se.WEAK} ELSE 0 END) AS points FROM f CROSS JOIN ro GROUP BY ALL),
lw AS (SELECT site, page_id, key, text, internal FROM li UNION ALL SELECT e.site, e.src, f.key, {ROLE_WORD.replace('page_id', 'f.page_id')}, true FROM e JOIN f ON f.page_id = e.dst),
an AS (SELECT site, key, role, count(*) * {se.ANCHOR} AS points FROM lw JOIN ro ON internal AND regexp_matches(lower(text), pattern) GROUP BY ALL),
ho AS (SELECT site, min(page_id) AS home, count(*) AS pages FROM h GROUP BY site), il AS (SELECT li.site, key, count(*) AS inlinks, bool_or(page_id = home) AS from_home FROM lw AS li JOIN ho USING (site) WHERE internal GROUP BY ALL),
sc AS (SELECT ow.site, ow.role, page_id, ow.key, ow.points + coalesce(an.points, 0) AS score FROM ow LEFT JOIN an ON an.site = ow.site AND an.key = ow.key AND an.role = ow.role),
be AS (SELECT *, least(0.99, 0.42 + 0.1 * score) AS level, row_number() OVER (PARTITION BY site, role ORDER BY least(0.99, 0.42 + 0.1 * score) DESC, page_id) AS r FROM sc WHERE score >= {se.LEAST})
SELECT be.site, role, page_id, CAST(score AS BIGINT) AS score, CAST(floor(100 * level + 0.5) AS INTEGER) AS confidence, coalesce(inlinks, 0) AS inlinks, coalesce(from_home, false) OR coalesce(inlinks, 0) >= greatest(2, floor(0.35 * pages + 0.5)) AS linked
FROM be JOIN ho ON ho.site = be.site LEFT JOIN il ON il.site = be.site AND il.key = be.key WHERE r = 1""")
def important_pages(spark: SparkSession, sf: str) -> DataFrame:
    f = pg.page_features(sq.pages(spark, sf)).withColumns({"key": urls.canonical_key(F.col("url")), "title": F.concat_ws(" ", "title", F.expr(ROLE_WORD))})
    to = f.select(F.col("page_id").alias("dst"), "key", F.expr(ROLE_WORD).alias("text"))
    more = sq.edges(spark, sf).join(to, "dst").select("site", F.col("src").alias("page_id"), "key", "text", F.lit(True).alias("internal"))
    links = sq.links(spark, sf).select("site", "page_id", "key", "text", "internal").unionByName(more)
    return se.important_pages(f.select("site", "page_id", "key", "path", "title", "h1", "visible_text"), links)


#: What a crawl met, by page number, in words of both engines; types and walls as answers name them.
CRAWLED = {
    "blocked": "page_id % 23 = 0", "status": "CASE WHEN page_id % 19 = 0 THEN 0 WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301 ELSE 200 END", "wall": "CASE WHEN page_id % 29 = 0 THEN 'Cloudflare' END",
    "content_type": "CASE WHEN page_id % 11 = 0 THEN 'application/pdf' WHEN page_id % 2 = 0 THEN 'text/html; charset=utf-8' ELSE '' END", "feedable": "words >= 60",
}
_CRAWLED = f"""{d.MAIN}, cf AS (SELECT page_id, site, nullif(title, '') AS title, len({d.words('main')}) AS words FROM f), cr AS (SELECT page_id, site, title, {', '.join(f'{e} AS {c}' for c, e in CRAWLED.items())} FROM cf),
ju AS (SELECT page_id, site, CASE {' '.join(f"WHEN {c} THEN '{r}'" for r, c in se.FEED_STEPS)} END AS reason FROM cr)"""


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    f = pg.page_features(sq.pages(spark, sf)).select("page_id", "site", F.nullif("title", F.lit("")).alias("title"), F.col("word_count").alias("words"))
    return f.select("page_id", "site", "title", *[F.expr(e).alias(c) for c, e in CRAWLED.items()])


@query(f"WITH {_CRAWLED} SELECT page_id, reason FROM ju")
def feed_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return se.feed_cascade(crawled(spark, sf)).select("page_id", "reason")


_STEP_ROWS = ", ".join(f"({k + 1}, '{r}')" for k, (r, _) in enumerate(se.FEED_STEPS))


@query(f"""WITH {_CRAWLED}, st AS (SELECT * FROM (VALUES {_STEP_ROWS}) AS t(step, reason)), n AS (SELECT ju.site, coalesce(s.step, 99) AS step FROM ju LEFT JOIN st AS s ON s.reason = ju.reason)
SELECT n.site, st.step, st.reason, count(*) FILTER (n.step = st.step) AS left_out, count(*) FILTER (n.step >= st.step) AS reached FROM n CROSS JOIN st GROUP BY n.site, st.step, st.reason""")
def feed_cascade_counts(spark: SparkSession, sf: str) -> DataFrame:
    return se.cascade_counts(se.feed_cascade(crawled(spark, sf)))


#: Alternates of a page: itself, the next of its site and, but for every third, the one before.
_ALT = """al AS (SELECT url AS url_key, url AS href_key, regexp_extract(path, '^/([a-z]{2})/', 1) AS lang FROM pl
UNION ALL SELECT a.url, b.url, regexp_extract(b.path, '^/([a-z]{2})/', 1) FROM pl AS a JOIN pl AS b ON a.site = b.site AND (b.n = a.n + 1 OR (b.n = a.n - 1 AND a.page_id % 3 > 0)))"""
_ALTERNATES = f"{d.PAGE}, pl AS (SELECT site, page_id, url, path, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM h), {_ALT}"


def alternates(spark: SparkSession, sf: str) -> DataFrame:
    pages = sq.pages(spark, sf).select(urls.site(F.col("url")).alias("site"), "page_id", "url", urls.path(F.col("url")).alias("path"))
    placed = pages.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("page_id")))
    return spark.sql(f"WITH {_ALT.replace('FROM pl', 'FROM {pl}').replace('JOIN pl', 'JOIN {pl}')} SELECT * FROM al".replace("{2}", "{{2}}"), pl=placed)


@query(f"""WITH {_ALTERNATES}, e AS (SELECT DISTINCT * FROM al) SELECT url_key, href_key, lang, CASE WHEN url_key = href_key THEN 'self' WHEN EXISTS (SELECT 1 FROM e AS b WHERE b.url_key = e.href_key AND b.href_key = e.url_key) THEN 'returned'
 WHEN EXISTS (SELECT 1 FROM e AS b WHERE b.url_key = e.href_key) THEN 'one_way' ELSE 'unknown' END AS state FROM e""")
def language_returns(spark: SparkSession, sf: str) -> DataFrame:
    return se.return_links(alternates(spark, sf))


@query(f"""WITH {_ALTERNATES}, g AS (SELECT pl.site, min(url) OVER (PARTITION BY pl.site) AS cluster, url, count(*) OVER (PARTITION BY pl.site) AS pages FROM pl),
e AS (SELECT DISTINCT url_key, href_key FROM al WHERE url_key <> href_key)
SELECT g.cluster, any_value(g.pages) AS pages, (SELECT count(DISTINCT lang) FROM al JOIN g AS x ON x.url = al.url_key WHERE x.cluster = g.cluster) AS languages, (SELECT count(*) FROM e JOIN g AS x ON x.url = e.url_key WHERE x.cluster = g.cluster) AS links,
 any_value(g.pages) * (any_value(g.pages) - 1) - (SELECT count(*) FROM e JOIN g AS x ON x.url = e.url_key WHERE x.cluster = g.cluster) AS holes FROM g WHERE g.pages > 1 GROUP BY g.cluster""")
def language_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that share an address count each, as in its SQL."""
    return se.language_clusters(alternates(spark, sf), sq.pages(spark, sf).select(F.col("url").alias("url_key")))


#: Facts of a site from its pages' own markup and text, in words of both engines; {pages} is (site, page_id, lang,
#: scripts, words, title).
FACTS = """SELECT site, count(*) AS pages, count_if(scripts > 0) AS with_scripts, nullif(min(lang), '') AS language, min(lang) IN ('en', 'de', 'fr', 'es') AS supported,
 CASE WHEN count_if(words >= 60) * 2 >= count(*) THEN 'blog' WHEN count(*) % 2 = 0 THEN 'business' ELSE 'ecommerce' END AS site_type, count_if(words >= 60) AS content_pages, CAST(max(words) AS BIGINT) AS longest,
 CAST(count_if(words >= 120) * 100 AS DOUBLE) / nullif(count_if(words >= 60), 0) AS useful_pct, CAST(count_if(words >= 60 AND words < 120) * 100 AS DOUBLE) / nullif(count_if(words >= 60), 0) AS thin_pct,
 count(*) - count(DISTINCT title) AS duplicates, CAST((count(*) - count(DISTINCT title)) * 100 AS DOUBLE) / count(*) AS duplicate_pct, CAST(NULL AS BOOLEAN) AS ads_present FROM {pages} GROUP BY site"""
_FACTS = f"""{d.MAIN}, fp AS (SELECT site, page_id, regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<script[\\s>]')) AS scripts, len({d.words('main')}) AS words, title FROM f), fa AS ({FACTS.replace('{pages}', 'fp')})"""
_LEVELS = " UNION ALL ".join(f"SELECT site, '{r}' AS requirement, CASE {' '.join(f'WHEN {c} THEN {_text(v)}' for v, c in steps)} END AS level FROM fa" for r, steps in se.REQUIREMENTS)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    f = pg.page_features(sq.pages(spark, sf)).select("site", "page_id", "lang", "scripts", F.col("word_count").alias("words"), "title")
    return spark.sql(FACTS, pages=f)


@query(f"WITH {_FACTS}, lv AS ({_LEVELS}) SELECT * FROM lv WHERE level IS NOT NULL")
def requirement_findings(spark: SparkSession, sf: str) -> DataFrame:
    return se.requirement_findings(facts(spark, sf))


_STATES = " UNION ALL ".join(
    f"SELECT s.site, '{need}' AS need, CASE WHEN count(*) FILTER (level IN ('high', 'medium', 'critical')) > 0 THEN 'not met' WHEN count(*) FILTER (level = 'manual') > 0 THEN 'manual' WHEN count(level) > 0 THEN 'met' ELSE 'unknown' END AS state FROM (SELECT DISTINCT site FROM lv) AS s LEFT JOIN lv ON lv.site = s.site AND level IS NOT NULL AND requirement IN ({d.names(names)}) GROUP BY s.site"
    for need, names in se.NEEDS
)


@query(f"WITH {_FACTS}, lv AS ({_LEVELS}) {_STATES}")
def requirement_states(spark: SparkSession, sf: str) -> DataFrame:
    return se.requirement_states(se.requirement_findings(facts(spark, sf)))


#: A bundle for each event, as text; some break off, some lack a part.
BUNDLE = """CASE WHEN event_id % 31 = 0 THEN '{"meta": ' WHEN event_id % 29 = 0 THEN '[]' WHEN event_id % 23 = 0 THEN '{"vitals": {}}'
 ELSE concat('{"meta": {"finalUrl": "https://a.example/', user_id, '", "transport": "', CASE WHEN event_id % 19 = 0 THEN 'pigeon' ELSE 'browser-direct' END, '"}, "vitals": {"lcp": ', event_id % 5000, ', "inp": ', CASE WHEN event_id % 7 = 0 THEN '"fast"' ELSE '80' END, '}, "resources": ', CASE WHEN event_id % 17 = 0 THEN '{}' ELSE '[1, 2]' END, '}') END"""
_BUNDLE_ERROR = "CASE WHEN event_id % 31 = 0 THEN 'not JSON' WHEN event_id % 29 = 0 THEN 'missing bundle' WHEN event_id % 23 = 0 THEN 'no metadata' WHEN event_id % 19 = 0 THEN 'unknown transport' WHEN event_id % 17 = 0 THEN 'resources is no list' END"


def read_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return se.bundles(read_table(spark, sf, "events").select(F.col("event_id").alias("key"), F.expr(BUNDLE).alias("value")))


@query(f"SELECT event_id AS key, 'https://a.example/' || user_id AS url, 'browser-direct' AS transport, CAST(event_id % 5000 AS DOUBLE) AS lcp, CASE WHEN event_id % 7 > 0 THEN 80.0::DOUBLE END AS inp, CAST(2 AS BIGINT) AS resources FROM events WHERE {_BUNDLE_ERROR} IS NULL")
def bundle_rows(spark: SparkSession, sf: str) -> DataFrame:
    return se.accepted(read_bundles(spark, sf)).select("key", "url", "transport", "lcp", "inp", "resources")


@query(f"SELECT event_id AS key, {_BUNDLE_ERROR} AS error FROM events WHERE {_BUNDLE_ERROR} IS NOT NULL")
def bundle_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no bundles; with bundle_rows they are all lines."""
    return se.quarantined(read_bundles(spark, sf)).select("key", "error")
