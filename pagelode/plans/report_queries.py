"""Queries on a report's rows, orders, importance by all terms, sitemap indexes and ads.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import classify as cl
from pagelode.operators import outputs as out
from pagelode.operators import pages as pg
from pagelode.operators import reports as rp
from pagelode.operators import site_evidence as se
from pagelode.plans import duck as d
from pagelode.plans import output_queries as oq
from pagelode.plans import site_queries as sq
from pagelode.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


#: Findings for each page, by what it holds, in words of both engines; {pa} is (site, page_id, words, title, scripts, html_bytes).
FINDINGS = """SELECT site, CASE WHEN words < 60 THEN 'high' ELSE 'passed' END AS status, 'content' AS category, CAST(page_id AS VARCHAR(20)) AS page, 'Text' AS name, CAST(words AS VARCHAR(20)) AS evidence, CAST(words % 100 AS INT) AS confidence FROM {pa}
UNION ALL SELECT site, 'low', 'title', CAST(page_id AS VARCHAR(20)), 'Title', title, CAST(length(title) AS INT) FROM {pa} WHERE length(title) < 40
UNION ALL SELECT site, 'manual', 'policy', 'Site', 'Look', CAST(count(*) AS VARCHAR(20)), 50 FROM {pa} GROUP BY site"""
_PA = f"{d.MAIN}, pa AS (SELECT site, page_id, CAST(len({d.words('main')}) AS INTEGER) AS words, title, len(regexp_extract_all(html, '(?i)<script[\\s>]')) AS scripts, octet_length(encode(html)) AS html_bytes FROM f)"


def described(spark: SparkSession, sf: str) -> DataFrame:
    return pg.page_features(sq.pages(spark, sf)).select("site", "page_id", F.col("word_count").alias("words"), "title", "scripts", "html_bytes", "path", "url", "h1")


_RANK = f"CASE status {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {k}' for k, s in enumerate(rp.ORDER))} END"


@query(f"""WITH {_PA}, fi AS ({FINDINGS.replace('{pa}', 'pa')}) SELECT site, status, page, name, CAST(row_number() OVER (PARTITION BY site ORDER BY {_RANK}, confidence DESC, name, page) AS INTEGER) AS rank FROM fi
WHERE category <> 'policy' AND page <> 'Site' AND contains(lower(name || ' ' || evidence || ' ' || page), 't')""")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of single pages with a `t` in them, as a reader would search."""
    found = spark.sql(FINDINGS, pa=described(spark, sf))
    return rp.report_rows(found.where("category <> 'policy'"), scope="page", search="T").select("site", "status", "page", "name", "rank")


@query(f"""WITH {_PA}, o AS (SELECT site, CASE WHEN words < 60 THEN 'short' ELSE 'long' END AS section, page_id, CASE WHEN page_id % 4 = 0 THEN page_id % 3 END AS user_order, words AS score FROM pa)
SELECT page_id, CAST(row_number() OVER (PARTITION BY site, section ORDER BY user_order NULLS LAST, score DESC, page_id) AS INTEGER) AS place FROM o""")
def user_orders(spark: SparkSession, sf: str) -> DataFrame:
    p = described(spark, sf)
    rows = p.select("site", F.when(F.col("words") < 60, "short").otherwise("long").alias("section"), "page_id", F.when(F.col("page_id") % 4 == 0, F.col("page_id") % 3).alias("user_order"), F.col("words").alias("score"))
    return rp.user_ordered(rows).select("page_id", "place")


#: What importance() asks of a page, in words of both engines; {pa} as above with path.
TERMS = """SELECT page_id, CASE WHEN words >= 300 THEN 'Guides' WHEN words >= 60 THEN 'Blog' WHEN page_id % 5 = 0 THEN 'Tags' ELSE 'Other' END AS category, CAST(page_id % 6 AS INT) AS depth, CAST(page_id % 25 AS INT) AS inlinks, page_id % 3 = 0 AS nav_linked, page_id % 2 = 0 AS footer_linked, page_id % 4 > 0 AS in_sitemap,
 title, words AS word_count, h1, CAST(page_id % 4 AS INT) AS h2_count, CASE WHEN page_id % 2 = 0 THEN url END AS canonical, page_id % 8 = 0 AS canonicalised, CAST(page_id % 3 AS INT) AS params, CAST(page_id % 5 AS INT) AS crumbs, CASE WHEN page_id % 3 > 0 THEN title END AS description, '' AS og FROM {pa}"""
_TERMS = f"""{d.MAIN}, pa AS (SELECT f.page_id, url, title, CAST(len({d.words('main')}) AS INTEGER) AS words, {d.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1 FROM f), te AS ({TERMS.replace('{pa}', 'pa')})"""
_FILLED = " + ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN 2 ELSE 0 END" for c in ("title", "description", "og", "canonical", "h1"))
_POINTS = "CASE category WHEN 'Guides' THEN 24 WHEN 'Blog' THEN 12 WHEN 'Tags' THEN -40 ELSE 4 END"


@query(f"""WITH {_TERMS}, s AS (SELECT page_id, least(99, greatest(0, CASE depth WHEN 0 THEN 25 WHEN 1 THEN 18 WHEN 2 THEN 10 WHEN 3 THEN 6 ELSE 3 END + CASE WHEN inlinks >= 20 THEN 18 WHEN inlinks >= 10 THEN 14 WHEN inlinks >= 5 THEN 10 WHEN inlinks >= 2 THEN 6 ELSE 2 END
 + CASE WHEN nav_linked THEN 20 WHEN footer_linked THEN 8 ELSE 0 END + CASE WHEN in_sitemap THEN 10 ELSE 0 END + CASE WHEN length(trim(title)) = 0 THEN 0 WHEN length(trim(title)) BETWEEN 10 AND 70 THEN 10 WHEN length(trim(title)) BETWEEN 5 AND 140 THEN 5 ELSE 2 END
 + CASE WHEN word_count >= 800 THEN 14 WHEN word_count >= 400 THEN 11 WHEN word_count >= 200 THEN 8 WHEN word_count >= 80 THEN 5 ELSE 1 END + CASE WHEN trim(h1) <> '' THEN 5 ELSE 0 END + CASE WHEN h2_count >= 2 THEN 5 ELSE 0 END
 + CASE WHEN canonical IS NOT NULL AND NOT canonicalised THEN 4 ELSE 0 END + CASE params WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 0 END + CASE WHEN crumbs >= 2 THEN 4 ELSE 0 END + {_FILLED} + {_POINTS})) AS importance FROM te)
SELECT page_id, CAST(importance AS INTEGER) AS importance, {cl.BAND} AS band FROM s""")
def full_importance(spark: SparkSession, sf: str) -> DataFrame:
    """R5 with all terms."""
    return cl.importance(spark.sql(TERMS, pa=described(spark, sf))).select("page_id", "importance", "band")


@query(f"""{'WITH ' + oq._LOC}, fl AS (SELECT DISTINCT site, file_no FROM nb) SELECT site, 'sitemap-index.xml' AS name, '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<sitemap><loc>https://' || site || '/sitemap-' || (file_no + 1) || '.xml</loc></sitemap>', '' ORDER BY file_no) || '</sitemapindex>' AS body
FROM fl GROUP BY site HAVING count(*) > 1""")
def sitemap_index_files(spark: SparkSession, sf: str) -> DataFrame:
    return rp.sitemap_index(out.sitemap_files(oq.locs(spark, sf), 4))


#: An ads.txt for each site, by its pages, in words of both engines; {si} is (site, n, m).
ADS = """SELECT site, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN '  ' WHEN m % 2 = 0 THEN concat('# sellers', chr(10), 'Net.example, 1, DIRECT', chr(10), chr(10), 'other.example, 2') ELSE 'other.example, 3' END AS body FROM {si}"""


@query(f"""WITH {d.PAGE}, si AS (SELECT site, count(*) AS n, min(page_id) AS m FROM h GROUP BY site)
SELECT site, n % 4 > 1 AS present, CAST(CASE WHEN n % 4 < 2 THEN 0 WHEN m % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS lines, n % 4 > 1 AND m % 2 = 0 AS has_network FROM si""")
def ads_txt_files(spark: SparkSession, sf: str) -> DataFrame:
    sites = read_table(spark, sf, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.min("page_id").alias("m"))
    return se.ads_txt(spark.sql(ADS, si=sites), "net.example")
