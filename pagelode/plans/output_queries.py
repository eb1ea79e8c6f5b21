"""Queries that write artefacts, judge links and read hosts; inputs follow from pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import classify as cl
from pagelode.operators import health as he
from pagelode.operators import hosts as ho
from pagelode.operators import outputs as out
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


def locs(spark, sf):
    return read_table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), F.col("page_id").alias("ord"), F.col("url").alias("loc"))


_X = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_LOC = f"{d.PAGE}, nb AS (SELECT site, page_id, url, (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) // 4 AS file_no, (row_number() OVER (PARTITION BY site ORDER BY page_id) - 1) % 4 AS pos FROM h)"


@query(f"""WITH {_LOC}, s AS (SELECT site, file_no, count(*) AS urls, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<url><loc>' || {_X.format('url')} || '</loc></url>', '' ORDER BY page_id) || '</urlset>' AS body FROM nb GROUP BY site, file_no)
SELECT site, file_no, urls, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, body FROM s""")
def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    return out.sitemap_files(locs(spark, sf), 4)


@query(f"WITH {_LOC} SELECT site, file_no, CAST(pos AS INTEGER) AS pos, url AS loc FROM nb")
def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    """S4 over the files that K3 makes."""
    return out.read_sitemaps(out.sitemap_files(locs(spark, sf), 4))


def items(spark, sf):
    """A feed item for each page, dated by its number; every seventh has no date."""
    f = sq.features(spark, sf)
    date = F.when(F.col("page_id") % 7 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id % 977 as int), 0, 0)"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    return f.select("site", F.col("page_id").alias("ord"), "page_id", F.regexp_replace("title", "[^A-Za-z ]", "").alias("title"), F.col("url").alias("loc"), F.regexp_replace("path", "[0-9]", "").alias("key"), folder.alias("folder"), date.alias("published"))


_ITEMS = f"""{d.MAIN}, im AS (SELECT site, page_id AS ord, regexp_replace(title, '[^A-Za-z ]', '', 'g') AS title, url AS loc, regexp_replace(path, '[0-9]', '', 'g') AS key, regexp_replace(path, '[^/]*$', '') AS folder,
 CASE WHEN page_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(page_id % 977 AS INTEGER)) END AS published FROM f)"""


@query(f"""WITH {_ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY ord) AS k FROM im), t AS (SELECT ord, row_number() OVER (PARTITION BY site, lower(trim(title)), folder ORDER BY ord) AS t FROM k WHERE k = 1)
SELECT k.ord, CASE WHEN k > 1 THEN 'Same URL' WHEN t > 1 AND trim(title) <> '' THEN 'Same title' END AS reason FROM k LEFT JOIN t ON t.ord = k.ord""")
def feed_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return out.unique_items(items(spark, sf)).select("ord", "reason")


_NEW = f"{_ITEMS}, nw AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY published DESC NULLS LAST, ord) AS rank FROM im)"


@query(f"WITH {_NEW} SELECT site, ord, CAST(rank AS INTEGER) AS rank FROM nw WHERE rank <= 3")
def newest_items(spark: SparkSession, sf: str) -> DataFrame:
    return out.newest(items(spark, sf), 3).select("site", "ord", "rank")


_FEED = f"""{_NEW}, fd AS (SELECT site, count(*) AS items, '<rss version="2.0"><channel><title>' || site || '</title>' || string_agg('<item><title>' || {_X.format('title')} || '</title><link>' || {_X.format('loc')} || '</link><pubDate>' || strftime(published, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>', '' ORDER BY rank) || '</channel></rss>' AS body FROM nw WHERE rank <= 3 AND published IS NOT NULL GROUP BY site)"""


def feeds(spark, sf):
    return out.feeds(out.newest(items(spark, sf), 3).where("published is not null"))


@query(f"WITH {_FEED} SELECT * FROM fd")
def rss_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return feeds(spark, sf)


@query(f"""WITH {_FEED}, r AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY rank) - 1 AS pos, {_X.format('title')} AS title, {_X.format('loc')} AS link, CAST(published AS DATE) AS published FROM nw WHERE rank <= 3 AND published IS NOT NULL) SELECT site, CAST(pos AS INTEGER) AS pos, title, link, published FROM r""")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """S6 and F18 over the feeds that K4 makes."""
    return out.read_feeds(feeds(spark, sf)).withColumn("published", F.to_date("published"))


@query(f"""WITH {_ITEMS}, a AS (SELECT DISTINCT site, key, 1 AS o, min(title) OVER (PARTITION BY site, key) AS was FROM im WHERE ord % 3 <> 0), b AS (SELECT DISTINCT site, key, 1 AS n, max(title) OVER (PARTITION BY site, key) AS now FROM im WHERE ord % 3 <> 1)
SELECT coalesce(a.site, b.site) AS site, coalesce(a.key, b.key) AS key, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN was IS DISTINCT FROM now THEN 'title changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.site = b.site AND a.key = b.key""")
def feed_compare(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf)
    old = i.where("ord % 3 <> 0").groupBy("site", "key").agg(F.min("title").alias("title"))
    return out.compare_feeds(old, i.where("ord % 3 <> 1").groupBy("site", "key").agg(F.max("title").alias("title")))


@query(f"WITH {d.MAIN} SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'Edited ' || page_id ELSE title END AS title FROM f")
def title_overrides(spark: SparkSession, sf: str) -> DataFrame:
    f = sq.features(spark, sf)
    return out.overridden(f, f.where("page_id % 10 = 0").select("page_id", F.concat(F.lit("Edited "), F.col("page_id").cast("string")).alias("title")))


@query(f"""WITH RECURSIVE {rq._IMP}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY importance DESC, page_id) AS r FROM im), b AS (SELECT *, row_number() OVER (PARTITION BY site, page_type ORDER BY importance DESC, page_id) AS k FROM i WHERE r > 2),
s AS (SELECT site, 'important' AS section, r AS rank, page_id FROM i WHERE r <= 2 UNION ALL SELECT site, page_type, k, page_id FROM b WHERE (page_type = 'guide' AND k <= 2) OR (page_type = 'article' AND k <= 3) OR (page_type = 'post' AND k <= 2)),
p AS (SELECT s.site, section, '## ' || section || chr(10) || string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY rank) AS block FROM s JOIN f ON f.page_id = s.page_id GROUP BY s.site, section)
SELECT site, '# ' || site || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY section) AS body FROM p GROUP BY site""")
def llms_txt(spark: SparkSession, sf: str) -> DataFrame:
    pages = sq.features(spark, sf).select("page_id", "title", F.col("url").alias("loc"))
    return out.llms_texts(cl.sections(rq.importance(spark, sf), rq.CAPS), pages)


@query(f"""WITH {d.PAGE}, n AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY site) AS size FROM h)
SELECT site, page_id FROM n WHERE size <= 3 OR k IN (0, size // 3, 2 * size // 3)""")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return out.sampled(sq.features(spark, sf).select("site", "page_id"), 3)


@query(f"""WITH {rq._FOUND}, p AS (SELECT site, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, array_to_string(list_sort(list_distinct(list("check"))), ',') AS checks FROM fi GROUP BY site), n AS (SELECT site, count(*) AS pages FROM fa GROUP BY site)
SELECT n.site, pages, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(checks, '') AS checks FROM n LEFT JOIN p ON n.site = p.site""")
def site_reports(spark: SparkSession, sf: str) -> DataFrame:
    f = rq.facts(spark, sf)
    return out.reports(cl.findings(f), f)


@query(f"""WITH {rq._FACTS}, v AS (SELECT site, {cl.INDEXABILITY} AS verdict FROM fa), n AS (SELECT site, count(*) AS urls, count(*) FILTER (verdict = 'Indexable') AS included, count(*) FILTER (verdict IN ('404', '410', 'Server error')) AS b, count(*) FILTER (verdict = 'Redirect') AS m FROM v GROUP BY site)
SELECT site, urls, included, {d.half_up('100 - least(40.0, 100.0 * b / urls) - least(20.0, 100.0 * m / urls)')} AS health FROM n""")
def sitemap_audit(spark: SparkSession, sf: str) -> DataFrame:
    return out.sitemap_audit(rq.facts(spark, sf).select("site", F.expr(cl.INDEXABILITY).alias("verdict")))


_CHECK = "CASE user_id % 9 WHEN 1 THEN 'DNS lookup failed' WHEN 2 THEN 'TLS handshake' WHEN 3 THEN 'timeout' ELSE '' END AS error, CASE event_id % 8 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 301 WHEN 5 THEN 410 ELSE 200 END AS status, (event_id % 2 = 0) AS is_internal"


def link_checks(spark, sf):
    return read_table(spark, sf, "events").selectExpr("event_id", "concat('site', user_id % 20) AS site", *[x.strip() for x in _CHECK.replace("AS error, ", "AS error|").replace("AS status, ", "AS status|").split("|")])


_LC = f"lc AS (SELECT event_id, 'site' || (user_id % 20) AS site, {_CHECK} FROM events), rs AS (SELECT *, {he.RESULT} AS result FROM lc), sv AS (SELECT *, {he.SEVERITY} AS severity FROM rs)"


@query(f"WITH {_LC} SELECT event_id, result, severity FROM sv")
def link_results(spark: SparkSession, sf: str) -> DataFrame:
    return he.results(link_checks(spark, sf)).select("event_id", "result", "severity")


@query(f"""WITH {_LC} SELECT site, count(*) AS links, CAST(greatest(0, 100 - least(50, 10 * count(*) FILTER (severity = 'critical')) - least(30, 5 * count(*) FILTER (severity = 'high')) - least(15, 3 * count(*) FILTER (severity = 'medium')) - least(10, count(*) FILTER (severity = 'low'))) AS BIGINT) AS score FROM sv GROUP BY site""")
def link_health(spark: SparkSession, sf: str) -> DataFrame:
    return he.health_score(he.results(link_checks(spark, sf)))


@query(f"""WITH {_LC}, a AS (SELECT event_id // 3 AS link, list(status ORDER BY event_id) AS s FROM lc GROUP BY link)
SELECT link, CASE WHEN len([x for x in s if x BETWEEN 200 AND 299]) > 0 THEN 'working' WHEN len([x for x in s if x NOT IN (404, 410)]) = 0 THEN 'confirmed_broken' WHEN s[-1] >= 500 THEN 'server_trouble' ELSE 'unclear' END AS verdict FROM a""")
def retry_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    a = link_checks(spark, sf).groupBy(F.floor(F.col("event_id") / 3).alias("link")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "status"))), lambda x: x["status"]).alias("s"))
    return a.select("link", he.retry_verdict(F.col("s")).alias("verdict"))


_HOPS = {
    "chain": "{div}", "step": "event_id % 4",
    "source": "CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'https' END || '://h' || (user_id % 5) || '/'",
    "target": "CASE WHEN event_id % 5 = 0 THEN 'http' ELSE 'https' END || '://h' || (user_id % 4) || '/'",
}
_HOP = ", ".join(f"{x} AS {n}" for n, x in _HOPS.items()).format(div="event_id // 4")


@query(f"""WITH e AS (SELECT {_HOP} FROM events), g AS (SELECT chain, count(*) AS hops, count(DISTINCT target) AS n, arg_min(source, step) AS a, arg_max(target, step) AS z, bool_or(source LIKE 'http:%' AND target LIKE 'https:%') AS to_https FROM e GROUP BY chain)
SELECT chain, hops, CASE WHEN hops = 1 THEN 'single' WHEN hops <= 3 THEN 'chain' ELSE 'long' END AS kind, n < hops AS loop, to_https, regexp_extract(a, '://([^/]+)', 1) <> regexp_extract(z, '://([^/]+)', 1) AS cross_host FROM g""")
def redirect_chains(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events").selectExpr(*[f"{x} AS {n}".format(div="event_id div 4") for n, x in _HOPS.items()])
    return he.redirects(rows)


#: The suffixes of this query alone; the hosts given have no others.
_SUFFIXES = "com net org co.uk example.com example.net"


@query(f"""WITH {d.PAGE}, s AS (SELECT unnest(string_split('{_SUFFIXES}', ' ')) AS suffix), m AS (SELECT page_id, host, arg_max(suffix, length(suffix)) AS suffix FROM h JOIN s ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY page_id, host)
SELECT page_id, suffix, nullif(regexp_extract(host, '([^.]+)\\.' || replace(suffix, '.', '\\.') || '$', 1), '') || '.' || suffix AS domain FROM m""")
def registrable_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return pages.join(ho.registrable(pages, ho.suffix_rules(spark, _SUFFIXES, "")), "host").select("page_id", "suffix", "domain")


_IPS = "CAST(10 + user_id % 3 AS VARCHAR) || '.' || (event_id % 256) || '.' || (user_id % 256) || '.' || (event_id % 250)"


@query(f"""WITH i AS (SELECT DISTINCT {_IPS} AS ip, (10 + user_id % 3) * 16777216 + (event_id % 256) * 65536 + (user_id % 256) * 256 + event_id % 250 AS n FROM events),
r AS (SELECT (10 + k) * 16777216 + j * 4194304 AS lo, (10 + k) * 16777216 + j * 4194304 + CASE WHEN j = 0 THEN 16777215 ELSE 4194303 END AS hi, CASE WHEN j = 0 THEN 8 ELSE 10 END AS len, 'p' || k || j AS provider FROM range(2) AS a(k), range(3) AS b(j))
SELECT ip, arg_max(provider, len) AS provider FROM i LEFT JOIN r ON n BETWEEN lo AND hi GROUP BY ip""")
def ip_providers(spark: SparkSession, sf: str) -> DataFrame:
    ip = F.concat_ws(".", (10 + F.col("user_id") % 3).cast("string"), (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 250).cast("string"))
    ips = read_table(spark, sf, "events").select(ip.alias("ip")).distinct().withColumn("n", he.ip_number(F.col("ip")))
    ranges = spark.range(6).selectExpr("id div 3 AS k", "id % 3 AS j").selectExpr("(10 + k) * 16777216 + j * 4194304 AS lo", "(10 + k) * 16777216 + j * 4194304 + if(j = 0, 16777215, 4194303) AS hi", "if(j = 0, 8, 10) AS len", "concat('p', k, j) AS provider")
    return he.providers(ips, ranges)


@query("""SELECT event_id, datediff('day', CAST(ts AS DATE), DATE '2024-02-20') AS days, CASE WHEN 20 - dayofmonth(ts) < 0 THEN 'expired' WHEN 20 - dayofmonth(ts) <= 7 THEN 'within 7 days' WHEN 20 - dayofmonth(ts) <= 30 THEN 'within 30 days' ELSE 'ok' END AS expiry FROM events""")
def domain_age(spark: SparkSession, sf: str) -> DataFrame:
    """F29 with event days as registration days; those of the month stand for expiry days."""
    e = read_table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.select("event_id", he.age(F.col("day"), F.lit("2024-02-20").cast("date"))["days"].alias("days"), he.expiry(F.lit("2024-01-20").cast("date"), F.col("day")).alias("expiry"))


@query("""WITH v AS (SELECT event_id, user_id % 4 AS a, event_id % 12 AS b, user_id % 3 AS x, event_id % 11 AS y FROM events) SELECT event_id, CASE WHEN (a, b) = (x, y) THEN 'current' WHEN (a, b) < (x, y) THEN 'older' ELSE 'newer' END AS state FROM v""")
def version_lag(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    v = lambda a, b: F.concat_ws(".", (F.col("user_id") % a).cast("string"), (F.col("event_id") % b).cast("string"))
    return e.select("event_id", he.version_state(v(4, 12), v(3, 11)).alias("state"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) = 1 AS agreed FROM n) SELECT user_id, event_type, votes, agreed FROM r WHERE r = 1""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return he.majority(read_table(spark, sf, "events"), "user_id", "event_type")
