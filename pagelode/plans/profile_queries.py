"""Queries on what a site's parts say of each other, and on rule profiles. Facts that the tables lack follow
from the numbers of pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import pages as pg
from pagelode.operators import profiles as pf
from pagelode.operators import site_parts as sp
from pagelode.plans import duck as d
from pagelode.plans import rule_queries as rq
from pagelode.plans import site_queries as sq
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


#: What both engines read in the same words; {pg} is (site, page_id, url, path, n, c): n-th of the site's c pages.
LINKS = """SELECT a.site AS site, a.page_id AS source, b.page_id AS target, CASE a.page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Intro' WHEN 2 THEN 'part%201' WHEN 3 THEN 'intro' ELSE 'gone' END AS fragment
FROM {pg} AS a JOIN {pg} AS b ON a.site = b.site AND b.n = a.n % a.c + 1"""
ANCHORS = "SELECT page_id AS target, 'intro' AS anchor FROM {pg} WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, 'part 1' FROM {pg} WHERE page_id % 2 = 0"
FETCHED = f"SELECT page_id, site, {rq.STATUS} AS status, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS hops FROM {{pg}}"
CANONICALS = """SELECT page_id, site, url, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN url || '#top' WHEN 2 THEN 'https://elsewhere.example/x' ELSE 'https://' || site || '/all' END AS canonical FROM {pg}"""
ALTERNATES = """SELECT page_id, url AS url_key, 'en' AS lang, url AS href_key FROM {pg} WHERE page_id % 3 = 0 UNION ALL SELECT page_id, url, 'x-default', 'https://elsewhere.example/' FROM {pg} WHERE page_id % 2 = 0
UNION ALL SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'english' ELSE 'en-US' END, 'https://elsewhere.example/en' FROM {pg}"""
RULES = """SELECT DISTINCT site, '*' AS agent, 'disallow' AS type, path FROM {pg} WHERE page_id % 3 <> {k} UNION SELECT DISTINCT site, 'gptbot', CASE WHEN c % 2 = {k} THEN 'allow' ELSE 'disallow' END, '/' FROM {pg}"""
RUNS = "SELECT DISTINCT site, t.category AS category, CAST((c * 7 + length(t.category) * {k}) % 100 AS INT) AS score FROM {pg} JOIN (SELECT 'technical' AS category, 0 AS o UNION ALL SELECT 'content', 1 UNION ALL SELECT 'mobile', 2) AS t ON t.o <> (c + {k}) % 4"
_PG = f"{d.PAGE}, pg AS (SELECT site, page_id, url, path, html, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n, count(*) OVER (PARTITION BY site) AS c FROM h)"


def _as(name: str, text: str) -> str:
    return f"{name} AS ({text.replace('{pg}', 'pg')})"


_LI, _AN, _FE, _CA, _AL = _as("li", LINKS), _as("an", ANCHORS), _as("fe", FETCHED), _as("ca", CANONICALS), _as("al", ALTERNATES)


def placed(spark, sf):
    p = read_table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), "page_id", "url", urls.path(F.col("url")).alias("path"))
    own = Window.partitionBy("site")
    return p.withColumns({"n": F.row_number().over(own.orderBy("page_id")), "c": F.count("*").over(own)})


def derived(spark, sf, text):
    return spark.sql(text, pg=placed(spark, sf))


@query(f"WITH {_PG}, {_LI}, {_FE} SELECT li.site, source, target, status, CASE WHEN status >= 400 THEN 'broken' ELSE 'redirect' END AS kind FROM li JOIN fe ON fe.page_id = target WHERE status >= 300")
def link_status(spark: SparkSession, sf: str) -> DataFrame:
    return sp.link_status(derived(spark, sf, LINKS), derived(spark, sf, FETCHED))


@query(f"""WITH {_PG}, {_LI} SELECT site, page_id FROM pg WHERE page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id NOT IN (SELECT target FROM li WHERE source % 4 = 1)""")
def sitemap_orphans(spark: SparkSession, sf: str) -> DataFrame:
    rows, links = placed(spark, sf), derived(spark, sf, LINKS)
    return sp.sitemap_orphans(rows.where("page_id % 2 = 0").select("site", "page_id"), links.where("source % 4 = 1"), rows.where("page_id % 3 = 0"))


@query(f"WITH {_PG}, {_FE} SELECT site, page_id, CASE WHEN status IN (404, 410) THEN 'broken_sitemap_url' ELSE 'redirecting_sitemap_url' END AS trouble FROM fe WHERE status IN (404, 410) OR status = 200 AND hops > 0")
def sitemap_trouble(spark: SparkSession, sf: str) -> DataFrame:
    return sp.listed_trouble(placed(spark, sf).select("site", "page_id"), derived(spark, sf, FETCHED))


def canonicals(spark, sf):
    c = derived(spark, sf, CANONICALS)
    return c.select("page_id", "canonical", F.col("site").alias("url_site"), urls.canonical_key(F.col("url")).alias("url_key"), urls.site(F.col("canonical")).alias("canonical_site"), urls.canonical_key(F.col("canonical")).alias("canonical_key"))


@query(f"WITH {_PG} SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'self' WHEN page_id % 4 = 2 THEN 'external' ELSE 'other' END AS decision FROM pg")
def canonical_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return sp.canonical_decision(canonicals(spark, sf)).select("page_id", "decision")


@query(f"WITH {_PG} SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'canonical_404' ELSE 'canonical_redirect' END AS issue FROM pg WHERE page_id % 4 = 2 OR page_id % 4 = 3 AND c % 2 = 0")
def canonical_targets(spark: SparkSession, sf: str) -> DataFrame:
    sites = placed(spark, sf).where("n = 1 and c % 2 = 0").select(F.concat(F.lit("https://"), "site", F.lit("/all")).alias("canonical_key"), F.lit(301).alias("status"))
    gone = sites.limit(0).unionByName(spark.range(1).select(F.lit("https://elsewhere.example/x").alias("canonical_key"), F.lit(404).alias("status")))
    return sp.canonical_targets(canonicals(spark, sf), sites.union(gone))


@query(f"""WITH {_PG}, {_LI} SELECT site, source, target, fragment FROM li WHERE fragment <> '' AND NOT (fragment IN ('Intro', 'intro') AND target % 3 <> 0) AND NOT (fragment = 'part%201' AND target % 2 = 0)""")
def missing_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return sp.missing_anchors(derived(spark, sf, LINKS), derived(spark, sf, ANCHORS)).select("site", "source", "target", "fragment")


@query(f"""WITH {_PG} SELECT page_id, CAST(1 + (page_id % 3 = 0)::INT + (page_id % 2 = 0)::INT AS BIGINT) AS alternates, CAST((page_id % 4 = 0)::INT AS BIGINT) AS invalid, page_id % 2 = 0 AS has_default, page_id % 3 = 0 AS has_self FROM pg""")
def language_links(spark: SparkSession, sf: str) -> DataFrame:
    return sp.language_links(derived(spark, sf, ALTERNATES))


@query(f"""WITH {_PG}, {_as('b', RULES.replace('{k}', '0'))}, {_as('a', RULES.replace('{k}', '1'))} SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def robots_changes(spark: SparkSession, sf: str) -> DataFrame:
    return sp.rule_changes(*(derived(spark, sf, RULES.replace("{k}", k)) for k in "01"))


@query(f"""WITH {_PG}, {_as('b', RUNS.replace('{k}', '1'))}, {_as('a', RUNS.replace('{k}', '2'))} SELECT coalesce(a.site, b.site) AS site, coalesce(a.category, b.category) AS category, coalesce(b.score, 0) AS previous, coalesce(a.score, 0) AS current, coalesce(a.score, 0) - coalesce(b.score, 0) AS change
FROM a FULL JOIN b ON a.site = b.site AND a.category = b.category""")
def run_changes(spark: SparkSession, sf: str) -> DataFrame:
    return sp.run_changes(*(derived(spark, sf, RUNS.replace("{k}", k)) for k in "21"))


RESOURCES = "SELECT event_id, user_id AS load_id, 'https://cdn.example/' || (event_id % 13) || '.js' AS url FROM {ev}"
METADATA = "SELECT DISTINCT user_id AS load_id, 'http://cdn.example/' || (event_id % 13) || '.js' AS url, 200 + 104 * CAST(event_id % 2 AS INT) AS status, 'text/javascript' AS content_type, 1000 * (event_id % 13) AS bytes FROM {ev} WHERE event_id % 5 <> 0"


@query(f"""WITH r AS ({RESOURCES.replace('{ev}', 'events')}), m AS ({METADATA.replace('{ev}', 'events')}), g AS (SELECT load_id, substr(url, 6) AS bare, min(status) AS status, max(bytes) AS bytes FROM m GROUP BY ALL)
SELECT event_id, r.load_id, url, status, CASE WHEN g.bare IS NOT NULL THEN 'text/javascript' END AS content_type, bytes FROM r LEFT JOIN g ON g.load_id = r.load_id AND g.bare = substr(url, 7)""")
def enriched_resources(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events")
    return sp.enriched(spark.sql(RESOURCES, ev=ev), spark.sql(METADATA, ev=ev)).select("event_id", "load_id", "url", "status", "content_type", "bytes")


@query(f"WITH r AS ({RESOURCES.replace('{ev}', 'events')}) SELECT DISTINCT load_id, url FROM r WHERE event_id % 3 = 0 EXCEPT SELECT load_id, url FROM r WHERE event_id % 3 <> 0")
def unused_preloads(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.sql(RESOURCES, ev=read_table(spark, sf, "events")).select("event_id", "load_id", "url")
    return sp.unused_preloads(r.where("event_id % 3 = 0").select("load_id", "url").distinct(), r.where("event_id % 3 <> 0"))


@query(f"""WITH {_PG}, x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2023-01-02' WHEN 2 THEN DATE '2022-07-09' WHEN 3 THEN DATE '2021-11-30' WHEN 4 THEN DATE '2020-02-29' END AS date,
 CASE page_id % 6 WHEN 0 THEN 'structured' WHEN 1 THEN 'meta' WHEN 2 THEN 'time' WHEN 3 THEN 'visible' WHEN 4 THEN 'lastmod' END AS source FROM pg) SELECT page_id, date, source, CASE WHEN source IS NOT NULL THEN source NOT IN ('visible', 'lastmod') END AS reliable FROM x""")
def publication_dates(spark: SparkSession, sf: str) -> DataFrame:
    """F20, J20; later sources are filled in as well, and dates out of range are passed over."""
    p, k = placed(spark, sf), F.col("page_id") % 6
    pages = p.select("page_id", F.when(k == 0, "2024-03-05T10:00:00Z").when(k == 1, "1889-01-01").alias("structured"), F.when(k <= 1, "2023-01-02").when(k == 2, "not a date").alias("meta"), F.when(k <= 2, "2022-07-09").when(k == 3, "2022-02-30").alias("time"), F.when(k <= 3, "2021-11-30").alias("visible"))
    return sp.dated(pages, p.where(k <= 4).select("page_id", F.lit("2020-02-29").alias("lastmod")), ("structured", "meta", "time", "visible"))


@query(f"""WITH {_PG}, {_LI}, {_FE} SELECT site, source AS page_id, 'link' AS producer, CASE WHEN status >= 400 THEN 'high' ELSE 'low' END AS severity, target AS other FROM li JOIN fe USING (site) WHERE fe.page_id = target AND status >= 300
UNION ALL SELECT site, page_id, 'canonical', 'medium', NULL FROM pg WHERE page_id % 4 >= 2 UNION ALL SELECT site, page_id, 'sitemap', 'medium', NULL FROM fe WHERE status IN (404, 410) OR status = 200 AND hops > 0""")
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    links = link_status(spark, sf).select("site", F.col("source").alias("page_id"), F.lit("link").alias("producer"), F.when(F.col("kind") == "broken", "high").otherwise("low").alias("severity"), F.col("target").alias("other"))
    canon = sp.canonical_decision(canonicals(spark, sf)).where("decision <> 'self'").select(F.col("url_site").alias("site"), "page_id", F.lit("canonical").alias("producer"), F.lit("medium").alias("severity"))
    return sp.united(links, canon, sitemap_trouble(spark, sf).select("site", "page_id", F.lit("sitemap").alias("producer"), F.lit("medium").alias("severity")))


_WORD = "($|[^a-z0-9_])"
_TYPE = f"""CASE WHEN regexp_matches(p, '/(login|signin|sign-in|log-in|register|signup|account|auth)(/|$)') THEN 'login' WHEN regexp_matches(p, '/search|/find') THEN 'search' WHEN regexp_matches(p, '/(author|user|profile|members)/') THEN 'author'
 WHEN p IN ('', '/') THEN 'homepage' WHEN t LIKE '%privacy%' THEN 'privacy' WHEN t LIKE '%contact%' THEN 'contact' WHEN p LIKE '%about%' AND regexp_matches(t, '(^|[^a-z0-9_])about{_WORD}') THEN 'about'
 WHEN regexp_matches(p, 'terms|legal') AND regexp_matches(t, 'terms|conditions') THEN 'terms' WHEN t LIKE '%disclaimer%' THEN 'disclaimer' WHEN p LIKE '%cookie%' THEN 'privacy' WHEN regexp_matches(p, '/(blog|news|article|post|story|guide|tutorial)/') THEN 'article'
 WHEN regexp_matches(p, '/(blog|news|articles|posts)/?$') THEN 'blog' WHEN regexp_matches(p, '/(product|item|shop|buy|pricing|plan)') THEN 'product' WHEN regexp_matches(p, '/(category|collection|tag|topics){_WORD}') THEN 'category'
 WHEN regexp_matches(p, '/(tool|calculator|converter|generator|checker|app){_WORD}') THEN 'tool' WHEN regexp_matches(p, '/(directory|listings?|sites)/') THEN 'directory' WHEN regexp_matches(p, '/(docs?|documentation|api|reference){_WORD}') THEN 'docs'
 WHEN regexp_matches(p, '/(forum|thread|topic){_WORD}') THEN 'forum' WHEN words >= 280 AND headings >= 2 THEN 'content' ELSE 'other' END"""
_H1 = d.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_TYPED = f"""{d.MAIN}, tp AS (SELECT page_id, site, title, main, lower(path) AS p, lower(title || ' ' || {_H1} || ' ' || path) AS t, len({d.words('main')}) AS words, len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS headings FROM f),
ty AS (SELECT *, {_TYPE} AS page_type FROM tp)"""


def typed(spark, sf):
    """Page features with the type of each page."""
    f = sq.features(spark, sf).join(read_table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?i)<h[1-6][\s>]"), F.lit(0))).alias("headings")), "page_id")
    return f.withColumn("page_type", pf.page_type(F.col("path"), F.col("title"), F.col("h1"), F.col("word_count"), F.col("headings")))


@query(f"WITH {_TYPED} SELECT page_id, page_type FROM ty")
def eligibility_types(spark: SparkSession, sf: str) -> DataFrame:
    return typed(spark, sf).select("page_id", "page_type")


def _inventory(content: str) -> str:
    return f"""WITH {_TYPED.replace(d.MAIN, sq.UNIQUE)}, x AS (SELECT uq.*, {content} AS c FROM uq JOIN ty ON ty.page_id = uq.page_id),
b AS (SELECT *, CASE WHEN NOT c THEN NULL WHEN word_count < 20 OR unique_words < 10 THEN 0.0 WHEN unique_words < 50 THEN 0.2 WHEN unique_words < 90 THEN 0.55 ELSE 1.0 END AS w FROM x),
s AS (SELECT site, count(*) AS pages, count(w) AS content_pages, count(*) FILTER (w = 0) AS empty, count(*) FILTER (w IN (0.2, 0.55)) AS thin, count(*) FILTER (c AND unique_words >= 70 AND word_count >= 20) AS useful, CAST(coalesce(sum(w), 0) AS DOUBLE) AS w FROM b GROUP BY site)
SELECT site, pages, content_pages, empty, thin, useful, CASE WHEN content_pages = 0 THEN 0 ELSE {d.half_up('100 * w / content_pages')} END AS useful_pct, CASE WHEN content_pages = 0 THEN 0 ELSE {d.half_up('100.0 * (empty + thin) / content_pages')} END AS thin_pct FROM s"""


def inventories(spark, sf, content):
    f = typed(spark, sf)
    return pg.inventory(pg.unique_words(f, pg.vocabulary(f)).join(f.select("page_id", "page_type"), "page_id"), content)


@query(_inventory("page_type IN ('content', 'article', 'blog')"))
def site_content_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A2 over pages whose type is content."""
    return inventories(spark, sf, F.col("page_type").isin(*pf.CONTENT_TYPES))


@query(_inventory("page_type NOT IN ('login', 'search')"))
def site_page_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """A2 over all pages but those that hold no text of their own."""
    return inventories(spark, sf, ~F.col("page_type").isin("login", "search"))


_KIND = {k: (p, w) for k, p, w in pf.SITE_TYPES}


@query(f"""WITH {_TYPED}, s AS (SELECT site, count(*) AS n, count(*) FILTER (page_type IN ('content', 'article', 'blog')) AS a, {', '.join(f"CASE WHEN bool_or(regexp_matches(lower(title || ' ' || main), '{p}')) THEN {w} ELSE 0 END AS {k}" for k, (p, w) in _KIND.items())} FROM ty GROUP BY site),
u AS (SELECT site, n, a, v.k, v.w, v.o FROM s, LATERAL (VALUES {', '.join(f"('{k}', {k}, {o})" for o, k in enumerate(_KIND))}) AS v(k, w, o)), b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, o) AS r FROM u)
SELECT site, CASE WHEN w > 1 THEN k WHEN a >= greatest(3, 0.4 * n) THEN 'blog' ELSE 'business' END AS site_type FROM b WHERE r = 1""")
def site_types(spark: SparkSession, sf: str) -> DataFrame:
    return pf.site_type(typed(spark, sf).select("site", F.concat_ws(" ", "title", "main_text").alias("text"), "page_type"))


@query(f"""WITH {_PG} SELECT page_id, CASE {' '.join(f"WHEN regexp_matches(lower(url), '{p}') THEN {w}" for p, w in pf.CRAWL_ORDER)} ELSE 10 END AS priority FROM pg""")
def crawl_priorities(spark: SparkSession, sf: str) -> DataFrame:
    return placed(spark, sf).select("page_id", pf.crawl_priority(F.col("url")).alias("priority"))


ANSWERS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Just a moment... Cloudflare challenge' WHEN 1 THEN 'please solve this hCaptcha captcha' WHEN 2 THEN 'Akamai: access denied to automated clients' WHEN 3 THEN 'protected by Sucuri cloudproxy'
 WHEN 4 THEN 'automated requests are blocked' WHEN 5 THEN 'DataDome' WHEN 6 THEN 'Akamai' ELSE 'hello' END AS body, CASE WHEN user_id % 6 = 0 THEN 'Imperva' ELSE 'nginx' END AS server, CASE user_id % 3 WHEN 0 THEN 403 ELSE 200 END AS status FROM {ev}"""


@query(f"""WITH a AS ({ANSWERS.replace('{ev}', 'events')}), x AS (SELECT *, event_id % 9 AS k FROM a) SELECT event_id, CASE WHEN k = 0 THEN 'Cloudflare' WHEN k = 1 THEN 'CAPTCHA' WHEN server = 'Imperva' THEN 'Imperva' WHEN k = 3 THEN 'Sucuri' WHEN k = 2 THEN 'Akamai'
 WHEN k = 5 THEN 'DataDome' WHEN k = 4 AND status = 403 THEN 'Unknown' END AS wall FROM x""")
def bot_walls(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ANSWERS, ev=read_table(spark, sf, "events")).select("event_id", pf.bot_wall(F.col("body"), F.col("server"), F.col("status")).alias("wall"))


@query(f"WITH {_PG} SELECT page_id, page_id % 4 IN (1, 3) AS skips FROM pg")
def heading_skips(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    levels = F.when(k == 0, F.array(*map(F.lit, (1, 2, 3, 2)))).when(k == 1, F.array(*map(F.lit, (1, 3)))).when(k == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(3)))
    return placed(spark, sf).select("page_id", pf.heading_skips(levels).alias("skips"))


@query(f"WITH {_PG}, x AS (SELECT site, path || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END AS p FROM pg), s AS (SELECT site, count(*) FILTER (p LIKE '%/') AS with_slash, count(*) FILTER (p NOT LIKE '%/') AS without_slash FROM x WHERE p NOT IN ('', '/') GROUP BY site) SELECT *, with_slash > 0 AND without_slash > 0 AS mixed FROM s")
def slash_use(spark: SparkSession, sf: str) -> DataFrame:
    return pf.slash_use(placed(spark, sf).select("site", F.concat("path", F.when(F.col("page_id") % 3 == 0, "/").otherwise("")).alias("path")))


_COUNTS = {"internal": "count_if(e % 2 = 0)", "external": "count_if(e % 2 = 1)", "broken_internal": "count_if(e % 2 = 0 AND e % 40 = 8)", "broken_external": "count_if(e % 2 = 1 AND e % 50 = 1)", "dns_errors": "count_if(e % 97 = 1)", "ssl_errors": "count_if(e % 89 = 1)", "server_errors": "count_if(e % 83 = 1)", "loops": "count_if(e % 301 = 1)", "long_chains": "count_if(e % 71 = 1)", "broken_anchors": "count_if(e % 67 = 1)"}
_TROUBLE = f"SELECT user_id % 40 AS site, {', '.join(f'{v} AS {k}' for k, v in _COUNTS.items())} FROM (SELECT user_id, event_id AS e FROM {{ev}}) AS x GROUP BY user_id % 40"


@query(f"""WITH c AS ({_TROUBLE.replace('{ev}', 'events')}), p AS (SELECT *, CASE WHEN broken_internal = 0 THEN 0 ELSE least(40, floor(80.0 * broken_internal / greatest(1, internal) + 2 * broken_internal + 0.5)) END AS i,
 CASE WHEN broken_external = 0 THEN 0 ELSE least(15, floor(50.0 * broken_external / greatest(1, external) + 0.5 * broken_external + 0.5)) END AS x FROM c),
s AS (SELECT site, CAST(greatest(0, least(100, floor(100 - CASE WHEN broken_internal >= 20 THEN least(50, i + 10) ELSE i END - x - least(20, 4 * dns_errors) - least(15, 3 * ssl_errors) - least(20, 3 * server_errors) - least(25, 8 * loops) - least(10, 2 * long_chains) - least(10, 1.5 * broken_anchors) + 0.5))) AS BIGINT) AS score FROM p)
SELECT site, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Needs Improvement' WHEN score >= 25 THEN 'Poor' ELSE 'Critical' END AS grade FROM s""")
def link_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pf.link_score(spark.sql(_TROUBLE, ev=read_table(spark, sf, "events"))).select("site", "score", "grade")


_LOADS = """SELECT event_id AS load_id, CASE WHEN event_id % 3 <> 0 THEN value * 60 END AS lcp, CASE WHEN event_id % 4 = 1 THEN value * 9 END AS inp, CASE WHEN event_id % 5 = 1 THEN value / 300 END AS cls, CASE WHEN event_id % 2 = 0 THEN value * 25 END AS ttfb, CASE WHEN event_id % 7 = 0 THEN value * 8 END AS tbt FROM {ev}"""


def _line(m, good, poor):
    return f"CASE WHEN {m} IS NULL THEN NULL WHEN {m} <= {good} THEN 100 WHEN {m} >= {poor} THEN 0 ELSE floor((1 - ({m} - {good}) / ({poor} - {good})) * 100 + 0.5) END"


@query(f"""WITH l AS ({_LOADS.replace('{ev}', 'events')}), v AS (SELECT load_id, coalesce(lcp, inp, cls) IS NOT NULL AS core, x.s, x.w FROM l, LATERAL (VALUES ({_line('lcp', 2500, 4000)}, 20), ({_line('inp', 200, 500)}, 20), ({_line('cls', 0.1, 0.25)}, 15), ({_line('ttfb', 800, 1800)}, 8), ({_line('tbt', 200, 600)}, 9)) AS x(s, w)),
m AS (SELECT load_id, CASE WHEN bool_and(core) THEN CAST(sum(s * w) AS DOUBLE) / sum(w) FILTER (s IS NOT NULL) END AS mean FROM v GROUP BY load_id)
SELECT load_id, floor(mean + 0.5) AS score, CASE WHEN mean >= 90 THEN 'Good' WHEN mean >= 50 THEN 'Needs Improvement' WHEN mean IS NOT NULL THEN 'Poor' END AS grade FROM m""")
def tool_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pf.tool_score(spark.sql(_LOADS, ev=read_table(spark, sf, "events"))).select("load_id", "score", "grade")


_FULL_LOADS = f"""SELECT l.*, CASE WHEN event_id % 6 <> 0 THEN value * 30 END AS fcp, event_id % 90 AS requests, CASE WHEN event_id % 5 <> 0 THEN value * 40000 END AS bytes, CASE WHEN event_id % 4 <> 0 THEN event_id % 8 END AS static, (event_id % 8) * 0.5 AS cacheable,
 event_id % 9 AS text, (event_id % 9) * 0.25 AS compressed, CASE WHEN event_id % 3 <> 0 THEN event_id % 16 END AS tasks, event_id % 6000 AS nodes FROM ({_LOADS}) AS l JOIN {{ev}} AS e ON e.event_id = l.load_id"""
_WITHIN = "least(100.0, greatest(0.0, {}))"


def _half_up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


@query(f"""WITH l AS ({_FULL_LOADS.replace('{ev}', 'events')}),
p AS (SELECT *, CASE WHEN requests > 0 AND bytes IS NOT NULL THEN {_half_up(f"({_WITHIN.format('100 - (requests - 20) * 1.1')} + {_WITHIN.format('100 - (bytes / 1024 - 400) / 40')}) / 2")} END AS rp,
 CASE WHEN static IS NOT NULL THEN {_WITHIN.format(_half_up("CASE WHEN static > 0 THEN CAST(cacheable AS DOUBLE) / static ELSE 1.0 END * 60") + " + CASE WHEN text > 0 THEN " + _half_up("CAST(compressed AS DOUBLE) / text * 40") + " ELSE 0 END")} END AS np,
 CASE WHEN tasks IS NOT NULL THEN {_WITHIN.format(_half_up(_WITHIN.format('100 - (tasks - 2) * 8')) + " - CASE WHEN nodes > 5000 THEN 25 WHEN nodes > 2000 THEN 10 ELSE 0 END")} END AS dp FROM l),
v AS (SELECT load_id, coalesce(lcp, inp, cls) IS NOT NULL AS core, x.s, x.w FROM p, LATERAL (VALUES ({_line('lcp', 2500, 4000)}, 20), ({_line('inp', 200, 500)}, 20), ({_line('cls', 0.1, 0.25)}, 15), ({_line('ttfb', 800, 1800)}, 8), ({_line('fcp', 1800, 3000)}, 8), ({_line('tbt', 200, 600)}, 9), (rp, 8), (np, 6), (dp, 6)) AS x(s, w)),
m AS (SELECT load_id, CASE WHEN bool_and(core) THEN CAST(sum(s * w) AS DOUBLE) / sum(w) FILTER (s IS NOT NULL) END AS mean FROM v GROUP BY load_id)
SELECT load_id, CAST(floor(mean + 0.5) AS DOUBLE) AS score, CASE WHEN mean >= 90 THEN 'Good' WHEN mean >= 50 THEN 'Needs Improvement' WHEN mean IS NOT NULL THEN 'Poor' END AS grade FROM m""")
def full_tool_scores(spark: SparkSession, sf: str) -> DataFrame:
    """R9 with all nine parts."""
    loads = spark.sql(_FULL_LOADS, ev=read_table(spark, sf, "events"))
    return pf.tool_score(pf.efficiency(loads)).select("load_id", F.col("score").cast("double").alias("score"), "grade")


_GUARD = "SELECT site, 30 AS known, c % 31 AS blocked, c % 5 = 0 AS wildcard, CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END AS errors, c % 3 AS warnings, c % 2 = 0 AS enforced, c % 4 AS own_groups, c % 6 = 0 AS whole_site, c % 2 AS paths FROM {pg} WHERE n = 1"


@query(f"""WITH {_PG}, {_as('g', _GUARD)}, s AS (SELECT site, CAST(floor(40.0 * least(1, (CASE WHEN wildcard THEN known ELSE blocked END) / known) + 0.5) + CASE WHEN errors > 0 THEN 0 WHEN warnings > 0 THEN 16 ELSE 25 END + CASE WHEN enforced THEN 20 ELSE 0 END
 + CASE WHEN own_groups > 0 THEN 10 ELSE 0 END + CASE WHEN whole_site THEN 5 WHEN paths > 0 THEN 3 ELSE 0 END AS BIGINT) AS score FROM g)
SELECT site, score, CASE WHEN score >= 85 THEN 'Strong configuration' WHEN score >= 60 THEN 'Moderate protection' WHEN score >= 35 THEN 'Basic protection' ELSE 'Minimal protection' END AS label FROM s""")
def protection_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pf.protection_score(derived(spark, sf, _GUARD)).select("site", "score", "label")


_CRAWL = "SELECT site, c % 9 = 0 AS challenge, c % 5 = 0 AS blocks_all, c % 8 AS parsed, c % 4 AS js_heavy, c % 6 AS errors, c AS fetched, 50 AS wanted FROM {pg} WHERE n = 1"


@query(f"""WITH {_PG}, {_as('g', _CRAWL)}, s AS (SELECT *, CASE WHEN parsed = 0 THEN 15 ELSE 90 - CASE WHEN challenge THEN 25 ELSE 0 END - CASE WHEN blocks_all THEN 20 ELSE 0 END - CASE WHEN js_heavy / parsed >= 0.5 THEN 20 ELSE 0 END END AS b FROM g)
SELECT site, CAST(least(96, greatest(12, b - CASE WHEN errors >= greatest(3, 0.4 * fetched) THEN 15 ELSE 0 END - CASE WHEN parsed < 3 THEN 10 ELSE 0 END)) AS BIGINT) AS confidence FROM s""")
def crawl_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return pf.crawl_confidence(derived(spark, sf, _CRAWL)).select("site", "confidence")


_ITEM = "SELECT site, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Title' END AS title, CASE WHEN page_id % 7 = 0 THEN '/relative' ELSE url END AS link, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Text' END AS description, page_id % 4 <> 0 AS dated, CASE WHEN page_id % 6 <> 0 THEN url ELSE '' END AS canonical, page_id % 8 <> 0 AS content FROM {pg}"
_STAT = "SELECT site, c % 3 <> 0 AS valid, c % 4 AS duplicates, c % 2 AS broken FROM {pg} WHERE n = 1"


@query(f"""WITH {_PG}, {_as('i', _ITEM)}, {_as('t', _STAT)}, a AS (SELECT site, count(*) AS items, avg((link LIKE 'http%')::INT) AS u, avg(0.4 * (title <> '')::INT + 0.3 * (link <> '')::INT + 0.3 * (description <> '')::INT) AS f, avg(dated::INT) AS d, avg((canonical = link)::INT) AS c, avg(content::INT) AS r FROM i GROUP BY site),
s AS (SELECT a.site, items, CASE WHEN valid THEN 20 ELSE 0 END AS v, {', '.join(f"floor({x} * 10 + 0.5) / 10 AS {k}" for k, x in (('p1', '15 * u'), ('p2', '15 * f'), ('p3', '15 * d'), ('p4', '10.0 * items / (items + duplicates)'), ('p5', '10.0 * items / (items + broken)'), ('p6', '10 * c'), ('p7', '5 * r')))} FROM a JOIN t ON a.site = t.site)
SELECT site, items, CAST(least(100, floor(v + p1 + p2 + p3 + p4 + p5 + p6 + p7 + 0.5)) AS BIGINT) AS score FROM s""")
def feed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return pf.feed_score(derived(spark, sf, _ITEM), derived(spark, sf, _STAT))


_POST, _GUIDE = "blog|post|posts|article|articles|news|press|updates|insights|journal|stories|story|media", "guide|guides|how-to|howto|tutorial|tutorials|resources"


@query(f"""WITH {_TYPED}, x AS (SELECT page_id, p, words AS w, page_id % 3 = 0 AS a, page_id % 4 = 0 AS dt, page_id % 16 AS links FROM ty),
k AS (SELECT page_id, CASE WHEN p = '/' THEN 'Homepage' WHEN regexp_matches(p, '^/(tag|tags)/') THEN 'Tag' WHEN regexp_matches(p, '^/(author|authors|writers?|staff)/|^/by/[^/]+/?$') THEN 'Author' WHEN regexp_matches(p, '^/(category|categories|section|sections|topic|topics|c)/') THEN 'Category'
 WHEN regexp_matches(p, '^/({_POST}|{_GUIDE})/[^/]+/?$') AND links >= 8 AND NOT a AND NOT dt AND w < 120 THEN 'Category' WHEN regexp_matches(p, '^/(docs|documentation|reference|api|developer|developers|manual|knowledge-base|kb|help|support|faq|faqs)/') THEN 'Documentation'
 WHEN regexp_matches(p, '^/(product|products|shop|store|item|items|cart|checkout|account|wishlist)/') THEN 'Product' WHEN a AND dt AND w >= 80 OR a AND w >= 150 OR dt AND w >= 150 THEN 'Article' WHEN regexp_matches(p, '^/({_POST})/') AND w >= 60 THEN 'Blog Post' WHEN regexp_matches(p, '^/({_GUIDE})/') AND w >= 60 THEN 'Guide'
 WHEN regexp_matches(p, '^/(about|about-us|contact|contact-us|privacy|privacy-policy|terms|terms-of-service|cookies|cookie-policy|disclaimer|sitemap|search|login|log-in|signin|sign-in|register|signup|sign-up|cart|checkout|account|pricing|careers|jobs|imprint|legal|licensing|media-kit|404|home)(/|$)') THEN 'Static Page' ELSE 'Other' END AS type FROM x)
SELECT page_id, type, type IN ('Article', 'Blog Post', 'News Article', 'Guide') AS feedable FROM k""")
def feed_classes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    rows = typed(spark, sf).select("page_id", "path", F.col("word_count").alias("words"), (k % 3 == 0).alias("has_article"), (k % 4 == 0).alias("has_date"), (k % 16).alias("links"))
    return pf.feed_class(rows).select("page_id", "type", "feedable")
