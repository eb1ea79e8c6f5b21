"""Queries on request chains, sitemap indexes, structured data and host names; inputs follow from pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import hosts as ho
from pagelode.operators import request_chains as rc
from pagelode.operators import sitemaps as sm
from pagelode.operators import structured as sd
from pagelode.operators import vitals as vt
from pagelode.plans import duck as d
from pagelode.plans import vitals_queries as vq
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


#: What a request of each type waits for: the latest of another type before it.
_WAITS = {"click": "view", "purchase": "click", "error": "purchase", "view": "signup", "signup": "error"}


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each event, which waits for the latest of a user's earlier events of the type before it."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = {was: F.last(F.when(F.col("event_type") == was, F.col("event_id")), ignorenulls=True).over(past) for was in _WAITS.values()}
    parent = F.coalesce(*[F.when(F.col("event_type") == own, latest[was]) for own, was in _WAITS.items()])
    return read_table(spark, sf, "events").select(F.col("user_id").alias("load_id"), F.col("event_id").alias("node"), parent.alias("parent"))


_REQUESTS = f"""rq AS (SELECT user_id AS load_id, event_id AS node, CASE event_type {' '.join(f"WHEN '{own}' THEN last_value(CASE WHEN event_type = '{was}' THEN event_id END IGNORE NULLS) OVER w" for own, was in _WAITS.items())} END AS parent FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH RECURSIVE {_REQUESTS}, r(load_id, node, path) AS (SELECT load_id, node, [node] FROM rq WHERE parent IS NULL UNION ALL SELECT rq.load_id, rq.node, list_append(r.path, rq.node) FROM r JOIN rq ON rq.load_id = r.load_id AND rq.parent = r.node),
k AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY len(path) DESC, node) AS k FROM r) SELECT load_id, len(path) AS length, array_to_string(path, '>') AS path FROM k WHERE k = 1""")
def dependency_chains(spark: SparkSession, sf: str) -> DataFrame:
    rows = rc.longest_chains(requests(spark, sf))
    return rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"""WITH {vq._TASKS}, w AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY latency DESC, start, id) AS k FROM it WHERE ok)
SELECT w.load_id, w.id AS interaction, count(*) AS tasks, round(sum(duration), 6) AS total FROM w JOIN ta ON ta.load_id = w.load_id AND ta.start BETWEEN w.start - 2000 AND w.start + w.latency + 2000 WHERE k = 1 GROUP BY ALL HAVING count(*) >= 2""")
def task_congestion(spark: SparkSession, sf: str) -> DataFrame:
    return vt.congestion(vq.tasks(spark, sf), vq.interactions(spark, sf)).withColumn("total", F.round("total", 6))


def sitemap_corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files and roots of sites that list two pages a file, two files an index, and all indexes in a root
    that their own entries lead back to."""
    pages = read_table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), "page_id", "url")
    n = F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1
    rows = pages.withColumn("leaf", F.floor(n / 2)).withColumn("mid", F.floor(F.col("leaf") / 2))
    at = lambda kind, k=None: F.concat(F.lit("https://"), "site", F.lit(f"/{kind}"), *([] if k is None else [F.col(k).cast("string")]), F.lit(".xml"))
    day = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("<lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 700).cast("int")).cast("string"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), day, F.lit("</url>"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "")
    child = lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))
    wrapped = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    leaves = rows.groupBy(at("leaf", "leaf").alias("url")).agg(wrapped("urlset", joined(entry)).alias("body"))
    mids = rows.groupBy("site", at("mid", "mid").alias("url")).agg(wrapped("sitemapindex", F.concat(joined(child(at("leaf", "leaf"))), child(at("root")))).alias("body"))
    tops = rows.groupBy("site", at("root").alias("url")).agg(wrapped("sitemapindex", joined(child(at("mid", "mid")))).alias("body"))
    files = leaves.union(mids.select("url", "body")).union(tops.select("url", "body"))
    return files, rows.select("site", at("root").alias("url")).distinct()


_SITEMAPS = f"""{d.PAGE}, nb AS (SELECT site, page_id, url, (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) // 2 AS leaf FROM h),
ed AS (SELECT DISTINCT site, 'root' AS a, 'mid' || (leaf // 2) AS b FROM nb UNION SELECT site, 'mid' || (leaf // 2), 'leaf' || leaf FROM nb UNION SELECT site, 'mid' || (leaf // 2), 'root' FROM nb),
fr(site, a, level) AS (SELECT DISTINCT site, 'root', 0 FROM nb UNION ALL SELECT DISTINCT fr.site, ed.b, level + 1 FROM fr JOIN ed ON ed.site = fr.site AND ed.a = fr.a WHERE level < 4),
lv AS (SELECT site, a, min(level) AS level FROM fr GROUP BY site, a)"""


@query(f"""WITH RECURSIVE {_SITEMAPS} SELECT site, 'https://' || site || '/' || a || '.xml' AS sitemap, CAST(level AS INTEGER) AS level, a NOT LIKE 'leaf%' AS is_index,
 CASE WHEN a LIKE 'leaf%' THEN (SELECT count(*) FROM nb WHERE nb.site = lv.site AND 'leaf' || leaf = a) ELSE (SELECT count(*) FROM ed WHERE ed.site = lv.site AND ed.a = lv.a) END AS entries FROM lv""")
def sitemap_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return sm.expanded(*sitemap_corpus(spark, sf))


@query(f"""WITH {d.PAGE}, ky AS (SELECT site, scheme || '://' || site || regexp_replace(path, '/+$', '') || {d.kept_query('query')} AS key, max(CASE WHEN page_id % 5 > 0 THEN DATE '2024-01-01' + CAST(page_id % 700 AS INTEGER) END) AS day FROM h GROUP BY ALL)
SELECT site, count(*) AS pages, count(*) FILTER (day IS NULL) AS missing, CAST(0 AS BIGINT) AS unreadable, count(*) FILTER (day > DATE '2025-01-01') AS future FROM ky GROUP BY site""")
def sitemap_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of all pages that a site's indexes lead to."""
    files, roots = sitemap_corpus(spark, sf)
    return sm.lastmod_issues(sm.listed_pages(files, sm.expanded(files, roots)), F.to_date(F.lit("2025-01-01")))


def marked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """pages with a JSON-LD block of their own: an article with its title, its folders as breadcrumbs in a
    graph, or, for every eleventh, a block that breaks off."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    steps = F.transform(F.filter(F.split(urls.path(F.col("url")), "/"), lambda s: s != ""), lambda s: F.named_struct(F.lit("name"), s))
    crumbs = F.named_struct(F.lit("@type"), F.lit("BreadcrumbList"), F.lit("itemListElement"), steps)
    article = F.to_json(F.named_struct(F.lit("@type"), F.array(F.lit("Article"), F.lit("Thing")), F.lit("headline"), title))
    graph = F.to_json(F.named_struct(F.lit("@graph"), F.array(crumbs)))
    text = F.when(F.col("page_id") % 11 == 0, F.expr("left('{\"@type\": \"Article\", ', 12)")).when(F.col("page_id") % 3 == 0, article).otherwise(graph)
    block = F.concat(F.lit('<script type="application/ld+json">'), text, F.lit("</script>"))
    return read_table(spark, sf, "pages").select("page_id", F.concat("html", block).alias("html"))


_KIND = "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'article,thing' ELSE 'breadcrumblist' END"


@query(f"""WITH {d.PAGE}, k AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, {_KIND} AS types FROM h)
SELECT page_id, types, CASE WHEN types = 'article,thing' THEN title END AS headline FROM k WHERE types IS NOT NULL""")
def structured_types(spark: SparkSession, sf: str) -> DataFrame:
    objs = sd.objects(sd.blocks(marked_pages(spark, sf)))
    rows = sd.types(objs).join(sd.field(objs, "article", "headline"), "page_id", "left")
    return rows.select("page_id", F.array_join("types", ",").alias("types"), F.col("value").alias("headline"))


@query(f"""WITH {d.PAGE} SELECT page_id, array_to_string([s for s in string_split(path, '/') if s <> ''], ' > ') AS crumbs, 'data' AS source FROM h WHERE page_id % 11 <> 0 AND page_id % 3 <> 0""")
def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    pages = marked_pages(spark, sf)
    rows = sd.breadcrumbs(pages, sd.objects(sd.blocks(pages)))
    return rows.select("page_id", F.array_join("crumbs", " > ").alias("crumbs"), "source")


_RULES = f"ru AS (SELECT regexp_replace(r, '^(!|\\*\\.)', '') AS tail, private, CASE WHEN r LIKE '!%' THEN 'exception' WHEN r LIKE '*.%' THEN 'wild' ELSE 'plain' END AS kind FROM (SELECT unnest(string_split('{ho.REGISTRY_SUFFIXES}', ' ')) AS r, false AS private UNION ALL SELECT unnest(string_split('{ho.SERVICE_SUFFIXES}', ' ')), true))"


@query(f"""WITH {d.PAGE}, {_RULES}, hl AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM h),
tl AS (SELECT host, len(l) AS n, i, array_to_string(l[i:], '.') AS tail FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM hl)),
fi AS (SELECT host, n, n - i + 1 + CASE kind WHEN 'wild' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END AS k, kind, private FROM tl JOIN ru USING (tail)),
be AS (SELECT host, k, private, row_number() OVER (PARTITION BY host ORDER BY kind = 'exception' DESC, k DESC) AS r FROM fi WHERE k BETWEEN 1 AND n),
al AS (SELECT hl.host, l, coalesce(k, 1) AS k, coalesce(private, false) AS private, k IS NOT NULL AS known FROM hl LEFT JOIN be ON be.host = hl.host AND r = 1)
SELECT host, array_to_string(l[len(l) - k + 1:], '.') AS suffix, CASE WHEN len(l) > k THEN array_to_string(l[len(l) - k:], '.') END AS domain, CASE WHEN len(l) > k + 1 THEN array_to_string(l[:len(l) - k - 1], '.') END AS subdomain, private, known FROM al""")
def host_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"))
    return ho.registrable(pages, ho.suffix_rules(spark))


#: What becomes of a host as someone types it, by page number; the error that it brings.
_TYPED = (("concat('HTTPS://', host, '/x?y')", None), ("concat(' ', host, '.:8080')", None), ("concat('ftp://', host)", "scheme"), ("concat('me@', host)", "credentials"), ("concat(host, ':0')", "port"), ("concat('-', host)", "characters"), ("concat('a..', host)", "empty label"), ("concat(host, '.test')", "reserved"))


@query(f"""WITH {d.PAGE}, t AS (SELECT page_id, host, page_id % {len(_TYPED)} AS k FROM h)
SELECT page_id, CASE WHEN k < 2 THEN host END AS host, CASE WHEN k = 1 THEN 8080 END AS port, CASE k {' '.join(f"WHEN {k} THEN '{e}'" for k, (_, e) in enumerate(_TYPED) if e)} END AS error FROM t""")
def domain_inputs(spark: SparkSession, sf: str) -> DataFrame:
    typed = F.expr(f"CASE page_id % {len(_TYPED)} {' '.join(f'WHEN {k} THEN {e}' for k, (e, _) in enumerate(_TYPED))} END")
    pages = read_table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host")).select("page_id", typed.alias("input"))
    return ho.parsed_input(pages).select("page_id", "host", "port", "error")
