"""Queries of content audits, readiness scores and exports. Findings, trust pages and llms.txt files follow from
the numbers of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.functions import urls
from pagelode.operators import audits as au
from pagelode.operators import categories as ca
from pagelode.operators import outputs as out
from pagelode.plans import duck as d
from pagelode.plans import output_queries as oq
from pagelode.plans import profile_queries as pq
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


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _all(x: str, pattern: str, g: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {g})"


def _phrases(k: int) -> str:
    gram = f"g{k} AS (SELECT page_id, unnest([array_to_string(w[i:i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) AS g FROM tq WHERE len(w) >= {k})"
    return f"{gram}, m{k} AS (SELECT page_id, max(n) AS m FROM (SELECT page_id, g, count(*) AS n FROM g{k} GROUP BY ALL) AS x WHERE n >= 4 GROUP BY page_id)"


_AUTHOR = "coalesce(nullif({}, ''), nullif({}, ''), nullif({}, ''))".format(
    d.plain("regexp_extract(html, '(?i)<meta[^>]*(?:name|property)=[\"''](?:author|article:author)[\"''][^>]*content=[\"'']([^\"'']*)', 1)"),
    d.plain("regexp_extract(html, '(?is)rel\\s*=\\s*[\"'']author[\"''][^>]*>(.*?)</', 1)"),
    d.plain("regexp_extract(html, '(?is)class\\s*=\\s*[\"''][^\"'']*(?:author|byline)[^\"'']*[\"''][^>]*>(.*?)</', 1)"),
)
_SRC = "list_distinct(" + _all("html", r"(?i)<{}\b[^>]*?\bsrc=[\"']([^\"']*)", 1) + ")"
_EV = f"""{pq._TYPED.replace(d.MAIN, sq.UNIQUE)},
tq AS (SELECT page_id, [x for x in {d.words('lower(main)')} if length(x) > 2 AND x NOT IN ({d.names(tx.STOP_WORDS)})] AS w FROM f), {_phrases(4)}, {_phrases(5)},
kt AS (SELECT page_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT page_id, {d.words('lower(main)')} AS w FROM f) AS x),
kc AS (SELECT page_id, word, count(*) AS uses, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos), word) AS r FROM kt WHERE length(word) >= 4 AND word NOT IN ({d.names(tx.STOP_WORDS)}) GROUP BY page_id, word),
ev AS (SELECT f.page_id, f.site, f.url, f.main, {d.visible('f.html')} AS visible, uq.word_count AS n, uq.unique_words AS u, uq.boilerplate_ratio AS bp, ty.page_type, ty.headings AS heads, ty.page_type IN ('content', 'article', 'blog') AS content,
  len({_all('html', '(?i)<p[' + chr(92) + 's>]')}) AS paras, CASE WHEN len({_all('f.main', '[^.!?]+[.!?]+')}) > 0 THEN len({_all('f.main', '[^.!?]+[.!?]+')}) WHEN f.main <> '' THEN 1 ELSE 0 END AS sents,
  coalesce(m4.m, 0) AS p4, coalesce(m5.m, 0) AS p5, kc.word AS kw, coalesce(kc.uses, 0) AS ku, [lower({d.plain('x')}) for x in {_all('html', '(?is)<h[12][^>]*>(.*?)</h[12]>', 1)}] AS h12, {_AUTHOR} AS author, {_has('html', au.CITED)} AS cited,
  {_has('substr(f.main, 1, 2000)', au.STOCK_INTRO)} AS intro, len({_all('f.main', au.SOURCES)}) AS src, {_SRC.format('script')} AS scripts, {_SRC.format('iframe')} AS frames, f.html
 FROM f JOIN uq ON uq.page_id = f.page_id JOIN ty ON ty.page_id = f.page_id LEFT JOIN m4 ON m4.page_id = f.page_id LEFT JOIN m5 ON m5.page_id = f.page_id LEFT JOIN kc ON kc.page_id = f.page_id AND kc.r = 1)"""


def evidence(spark, sf):
    """Only what an audit below asks for, as the operator writes what it is given."""
    typed = pq.typed(spark, sf).select("page_id", "site", "main_text", "visible_text", "word_count", "paragraphs", "headings", "page_type")
    return au.evidence(typed, au.markup(read_table(spark, sf, "pages")).select("page_id", "heads", "author", "cited"))


@query(f"""WITH {_EV}, x AS (SELECT *, CASE WHEN n >= 800 THEN 2 WHEN n >= 500 THEN 1 ELSE 0 END + CASE WHEN u >= 220 THEN 2 WHEN u >= 160 THEN 1 ELSE 0 END + CASE WHEN paras >= 6 THEN 1 WHEN paras >= 4 THEN 0.5 ELSE 0 END
 + CASE WHEN heads >= 3 THEN 1 WHEN heads >= 2 THEN 0.5 ELSE 0 END + CASE WHEN 1 - bp >= 0.5 THEN 1 ELSE 0 END + CASE WHEN sents >= 20 THEN 0.5 ELSE 0 END AS hits FROM ev),
s AS (SELECT site, count(*) FILTER (content) AS eligible, count(*) FILTER (content AND hits >= 4 AND n >= 500 AND u >= 160) AS long_form, count(*) FILTER (page_type IN ('category', 'tag') AND n < 40) AS empty_categories FROM x GROUP BY site),
c AS (SELECT *, CASE WHEN eligible > 0 THEN {d.half_up('CAST(long_form AS DOUBLE) / eligible * 100', 1)} ELSE 0 END AS coverage FROM s)
SELECT *, CASE WHEN eligible = 0 THEN 'medium' WHEN coverage >= 50 THEN 'passed' WHEN coverage >= 30 THEN 'medium' ELSE 'high' END AS status, CASE WHEN eligible = 0 THEN 'Needs Review' WHEN coverage >= 70 THEN 'Verified' WHEN coverage >= 50 THEN 'Likely' WHEN coverage >= 30 THEN 'Needs Review' ELSE 'Not Met' END AS requirement FROM c""")
def long_form_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return au.long_form(evidence(spark, sf))


@query(f"""WITH {_EV}, y AS (SELECT site, page_id, count(*) OVER (PARTITION BY site, md5(main)) > 1 AS twin FROM ev), du AS (SELECT site, {d.half_up('100.0 * count(*) FILTER (twin) / count(*)')} AS dup_pct FROM y GROUP BY site),
s AS (SELECT site, count(*) FILTER (content) AS content_pages, count(*) FILTER (content AND n >= 40 AND 1 - bp < 0.35) AS template_heavy, count(*) FILTER (content AND n >= 80 AND u < 40) AS low_unique, count(*) FILTER (p5 >= 5 AND content) AS a, count(*) FILTER (p5 >= 5) AS b FROM ev GROUP BY site),
z AS (SELECT s.*, dup_pct, greatest(1, content_pages) AS k FROM s JOIN du ON du.site = s.site)
SELECT site, content_pages, template_heavy, low_unique, CASE WHEN content_pages > 0 THEN a ELSE b END AS phrase_hits, dup_pct, CASE WHEN dup_pct >= 40 OR {d.half_up('100.0 * low_unique / k')} >= 50 OR template_heavy / k >= 0.5 THEN 'high' WHEN dup_pct >= 15 OR {d.half_up('100.0 * low_unique / k')} >= 25 OR template_heavy >= 2 THEN 'medium' ELSE 'passed' END AS status FROM z""")
def originality(spark: SparkSession, sf: str) -> DataFrame:
    """C7; duplicates are pages that share their main text with another of the site."""
    rows = evidence(spark, sf)
    alike = rows.groupBy("site", F.md5("main_text").alias("text")).agg(F.count("*").alias("n"))
    share = alike.groupBy("site").agg(tx.pct(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("dup_pct"))
    return au.originality(rows, share)


_HUMAN = f"""{_EV}, hs AS (SELECT *, length(coalesce(author, '')) >= 2 AS by_name, src >= 2 OR cited AS sourced, {_has('main', au.GENERIC)} OR intro AS generic, {_has('main', au.FIRST_HAND)} OR src >= 2 AND regexp_matches(substr(main, 1, 1500), '(?i)I |we ') AS fh FROM ev WHERE content),
hr AS (SELECT *, (coalesce(author, '') = '')::INT + 2 * generic::INT + 2 * (p4 >= 6)::INT + 2 * (bp > 0.65 AND u < 80)::INT + (NOT fh AND src < 1 AND u < 90)::INT AS risk FROM hs)"""


@query(f"""WITH {_HUMAN}, s AS (SELECT site, count(*) AS k, count(*) FILTER (by_name) AS a, count(*) FILTER (fh) AS b, count(*) FILTER (risk >= 4) AS l, count(*) FILTER (sourced) AS sourced FROM hr GROUP BY site),
p AS (SELECT site, k AS content_pages, {d.half_up('100.0 * a / k')} AS author_pct, {d.half_up('100.0 * b / k')} AS first_pct, {d.half_up('100.0 * l / k')} AS low_pct, sourced FROM s)
SELECT q.site, content_pages, author_pct, first_pct, low_pct, sourced, CASE WHEN content_pages IS NULL THEN 'manual' WHEN low_pct >= 50 AND first_pct < 15 AND author_pct < 20 THEN 'high' WHEN low_pct >= 30 OR first_pct < 10 AND author_pct < 15 THEN 'medium' ELSE 'passed' END AS status
FROM (SELECT DISTINCT site FROM ev) AS q LEFT JOIN p ON p.site = q.site""")
def human_involvement(spark: SparkSession, sf: str) -> DataFrame:
    return au.human_involvement(evidence(spark, sf))


@query(f"""WITH {_EV}, r AS (SELECT site, page_id, 2 * (ku >= 14 AND CAST(ku AS DOUBLE) / greatest(1, n) > 0.045)::INT + 2 * (p4 >= 8)::INT + (kw IS NOT NULL AND len([y for y in h12 if list_contains({d.words('y')}, kw)]) >= 3)::INT + intro::INT + (bp > 0.7)::INT
 + (len({_all("array_to_string(h12, ' ')", au.LIST_WORDS)}) >= 4 AND n < 500)::INT AS risk FROM ev) SELECT *, CASE WHEN risk >= 5 THEN 'high' WHEN risk >= 3 THEN 'medium' ELSE 'passed' END AS status FROM r""")
def search_first_risk(spark: SparkSession, sf: str) -> DataFrame:
    return au.search_first(evidence(spark, sf))


_ADS = f"""{_EV}, ad AS (SELECT site, n, html, len([x for x in scripts if {_has('x', au.AD_SCRIPTS)}]) + len([x for x in frames if {_has('x', au.AD_FRAMES)}]) + len({_all('html', au.AD_SLOTS)}) AS slots,
 len([x for x in {_all('html', '(?i)<a' + chr(92) + 'b[^>]*?' + chr(92) + 'bhref=["' + chr(39) + ']([^"' + chr(39) + ']*)', 1)} if {_has('x', au.DOWNLOADS)}]) AS downloads FROM ev)"""
_NETWORKS = ", ".join(f"CASE WHEN bool_or({_has('html', '(?i)' + p)}) THEN '{n}' END" for n, p in au.AD_NETWORKS)


@query(f"""WITH {_ADS}, s AS (SELECT site, count(*) FILTER (slots > 0) AS ad_pages, count(*) FILTER (slots >= 4 AND n < 250) AS heavy, concat_ws(',', {_NETWORKS}) AS networks, count(*) FILTER (downloads >= 2) AS download_pages FROM ad GROUP BY site)
SELECT *, CASE WHEN download_pages >= 3 THEN 'high' WHEN download_pages > 0 THEN 'medium' ELSE 'passed' END AS downloads FROM s""")
def ad_load(spark: SparkSession, sf: str) -> DataFrame:
    rows = sq.features(spark, sf).join(au.markup(read_table(spark, sf, "pages")), "page_id")
    return au.ad_load(rows)


@query(f"""WITH {_EV}, x AS (SELECT site, url, visible, visible || ' ' || array_to_string(scripts, ' ') AS code, url || ' ' || substr(visible, 1, 400) AS head FROM ev)
SELECT site, count(*) FILTER ({_has('url', au.EXCHANGE)}) AS exchange, count(*) FILTER ({_has('visible', au.INCENTIVE)}) AS incentive, count(*) FILTER ({_has('visible', au.CLAIM)}) AS claims, count(*) FILTER ({_has('code', au.TRACKERS)}) AS tracked, count(*) FILTER ({_has('head', au.GENERATORS)}) AS generators FROM x GROUP BY site""")
def traffic_signals(spark: SparkSession, sf: str) -> DataFrame:
    return au.traffic_signals(sq.features(spark, sf).join(au.markup(read_table(spark, sf, "pages")), "page_id"))


_SITES = "SELECT site, c % 4 = 0 AS email, c % 3 = 0 AS phone, c % 5 = 0 AS form FROM {pg} WHERE n = 1"
_FOUND = """SELECT site, CASE page_id % 7 WHEN 0 THEN 'privacy' WHEN 1 THEN 'contact' WHEN 2 THEN 'about' WHEN 3 THEN 'terms' WHEN 4 THEN 'disclaimer' WHEN 5 THEN 'cookie' ELSE 'privacy' END AS key,
 CAST(page_id * 31 % 200 AS INT) AS words, CASE WHEN page_id % 2 = 0 THEN 'We collect cookies' ELSE 'Hello' END AS text, page_id % 3 <> 0 AS linked FROM {pg}"""


@query(f"""WITH {pq._PG}, {pq._as('s', _SITES)}, {pq._as('fo', _FOUND)}, b AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY words DESC, text DESC, linked DESC) AS r FROM fo), k AS (SELECT s.*, v.id FROM s, (VALUES ('privacy'), ('contact'), ('about'), ('terms'), ('disclaimer'), ('cookie')) AS v(id))
SELECT k.site, id, CASE WHEN id = 'privacy' THEN CASE WHEN b.key IS NULL THEN 'high' WHEN NOT (text LIKE '%collect%' AND words >= 50 OR words >= 140) OR NOT linked THEN 'medium' ELSE 'passed' END
 WHEN id = 'contact' THEN CASE WHEN b.key IS NOT NULL AND (email OR form OR phone) THEN 'passed' WHEN b.key IS NOT NULL THEN 'medium' WHEN email OR form THEN 'low' ELSE 'high' END
 WHEN id = 'about' THEN CASE WHEN words >= 60 THEN 'passed' ELSE 'medium' END WHEN b.key IS NULL THEN 'low' ELSE 'passed' END AS status FROM k LEFT JOIN b ON b.site = k.site AND b.key = k.id AND b.r = 1""")
def trust_pages(spark: SparkSession, sf: str) -> DataFrame:
    return au.trust(pq.derived(spark, sf, _SITES), pq.derived(spark, sf, _FOUND))


_FINDINGS = """SELECT site, CASE page_id % 11 WHEN 0 THEN 'TECH_ROBOTS_BLOCK' WHEN 1 THEN 'TECH_NOINDEX' WHEN 2 THEN 'EZ-HTTPS' ELSE 'OTHER' END AS id, CASE page_id % 7 WHEN 0 THEN 'ezoic' WHEN 1 THEN 'content' WHEN 2 THEN 'tech' WHEN 3 THEN 'ux' WHEN 4 THEN 'trust' WHEN 5 THEN 'policy' ELSE 'monetization' END AS category,
 CASE (page_id * 3 + n) % 8 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'info' WHEN 5 THEN 'manual' ELSE 'passed' END AS status, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN 'Site' WHEN 2 THEN '/about' ELSE '/x' END AS page,
 CAST(page_id % 6 AS INT) AS weight, CASE WHEN page_id % 5 <> 0 THEN CAST(60 + page_id % 40 AS INT) END AS confidence, CASE page_id % 6 WHEN 0 THEN '3/4' WHEN 1 THEN '1/40' WHEN 2 THEN '45%' WHEN 3 THEN '4 %' WHEN 4 THEN '1 / 6' END AS affected FROM {pg}"""
_INVENTORY = "SELECT site, c % 5 AS content_pages, c * 13 % 100 AS useful_pct, c * 29 % 100 AS thin_pct, c * 17 % 60 AS dup_pct, CASE WHEN c % 6 = 0 THEN 'tools' ELSE 'blog' END AS site_type FROM {pg} WHERE n = 1"
_CATS = f"""{pq._PG}, {pq._as('fi', _FINDINGS)}, {pq._as('iv', _INVENTORY)},
z AS (SELECT site, CASE category WHEN 'monetization' THEN 'ezoic' ELSE category END AS category, status, CAST(coalesce(nullif(weight, 0), 3) AS DOUBLE) AS w, coalesce(confidence, 100) / 100 AS k, CASE status WHEN 'low' THEN 0.18 WHEN 'medium' THEN 0.48 WHEN 'high' THEN 0.82 WHEN 'critical' THEN 1 END AS loss,
 CASE affected WHEN '3/4' THEN 1.35 WHEN '1/40' THEN 0.45 WHEN '45%' THEN 1.1 WHEN '4 %' THEN 0.45 WHEN '1 / 6' THEN 0.75 ELSE 1 END AS reach, CASE WHEN page IN ('/', 'Site') THEN 1.15 WHEN page = '/about' THEN 1.1 ELSE 1 END AS place FROM fi),
s AS (SELECT site, category, sum(w * k) FILTER (status = 'passed') AS plus, sum(w * loss * k * reach * place) FILTER (loss IS NOT NULL) AS minus, count(*) FILTER (status IN ('high', 'critical')) AS high FROM z GROUP BY ALL),
y AS (SELECT iv.*, v.category, v.most, coalesce(plus, 0) AS plus, coalesce(minus, 0) AS minus, coalesce(high, 0) AS high FROM iv CROSS JOIN (VALUES ('ezoic', 30), ('content', 20), ('tech', 15), ('ux', 15), ('trust', 10), ('policy', 10)) AS v(category, most) LEFT JOIN s ON s.site = iv.site AND s.category = v.category),
p AS (SELECT *, round(least(CASE WHEN plus + minus > 0 THEN plus / (plus + minus) ELSE 0.62 END, CASE WHEN category = 'policy' AND high >= 2 THEN 0.25 WHEN category <> 'content' THEN 1.0 WHEN content_pages = 0 AND site_type <> 'tools' THEN 0.32 WHEN content_pages BETWEEN 1 AND 2 AND site_type <> 'tools' THEN 0.58
  WHEN useful_pct < 30 AND content_pages >= 3 THEN 0.42 WHEN thin_pct >= 60 THEN 0.48 WHEN dup_pct >= 40 THEN 0.5 ELSE 1.0 END), 9) AS x FROM y),
cs AS (SELECT site, category, CAST({d.half_up('x * 100')} AS BIGINT) AS pct, CAST({d.half_up('round(x * most, 6)')} AS BIGINT) AS score, high FROM p)"""


def scored(spark, sf):
    findings, inventory = pq.derived(spark, sf, _FINDINGS), pq.derived(spark, sf, _INVENTORY)
    return au.category_scores(findings, inventory), findings, inventory


@query(f"WITH {_CATS} SELECT * FROM cs")
def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)[0]


@query(f"""WITH {_CATS}, t AS (SELECT site, CAST(sum(score) AS BIGINT) AS t FROM cs GROUP BY site), m AS (SELECT site, bool_or(category = 'policy' AND status = 'critical') AS a, count(*) FILTER (category = 'policy' AND status = 'high') AS b, bool_or(id = 'TECH_ROBOTS_BLOCK') AS r, bool_or(id = 'TECH_NOINDEX' AND page = '/') AS i, bool_or(id = 'EZ-HTTPS' AND status <> 'passed') AS h FROM fi GROUP BY site),
j AS (SELECT t.site, t, a, b, r, i, h, content_pages >= 3 AND site_type <> 'tools' AND useful_pct < 20 AS few, content_pages >= 3 AND site_type <> 'tools' AND useful_pct >= 20 AND thin_pct >= 60 AS thin FROM t JOIN m ON m.site = t.site JOIN iv ON iv.site = t.site),
q AS (SELECT *, least(t, CASE WHEN a THEN 22 ELSE 100 END, CASE WHEN b >= 3 THEN 38 ELSE 100 END, CASE WHEN r THEN 28 ELSE 100 END, CASE WHEN i THEN 35 ELSE 100 END) AS t1 FROM j),
w AS (SELECT *, CASE WHEN h THEN least(t1, greatest(t1 - 10, 20)) ELSE t1 END AS t2 FROM q), e AS (SELECT *, least(t2, CASE WHEN few THEN 42 WHEN thin THEN 52 ELSE 100 END) AS total FROM w)
SELECT site, CAST(total AS BIGINT) AS total, concat_ws(',', CASE WHEN a THEN 'critical' END, CASE WHEN b >= 3 THEN 'policy' END, CASE WHEN r THEN 'robots' END, CASE WHEN i THEN 'noindex' END, CASE WHEN h THEN 'https' END, CASE WHEN few THEN 'useful' END, CASE WHEN thin THEN 'thin' END) AS caps,
 CASE WHEN total < 40 THEN 'Not Ready' WHEN total < 70 OR b > 0 OR r OR h THEN 'Needs Improvement' ELSE 'Likely Ready' END AS verdict FROM e""")
def site_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return au.site_verdicts(*scored(spark, sf))


_ENTRY = """SELECT site, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'About us' ELSE 'Title' END AS title, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Short text' ELSE 'A description of more than forty signs in all.' END AS description, CASE page_id % 6 WHEN 0 THEN 'Home' WHEN 1 THEN 'About' ELSE 'Docs' END AS category,
 page_id % 13 = 0 AS broken, page_id % 17 = 0 AS duplicate, page_id % 7 = 0 AS canonicalized FROM {pg}"""
_FILE = "SELECT site, c % 5 AS sections, c * 3 AS discovered FROM {pg} WHERE n = 1"


@query(f"""WITH {pq._PG}, {pq._as('en', _ENTRY)}, {pq._as('st', _FILE)}, a AS (SELECT site, count(*) AS pages, avg(broken::INT) AS b, avg(duplicate::INT) AS u, avg((title <> '')::INT) AS t, avg((length(description) >= 20)::INT) AS m, avg(nullif(length(description), 0)) AS n, bool_or(category = 'Home') AS home, bool_or(category = 'About' OR title = 'About us') AS about, avg(canonicalized::INT) AS x FROM en GROUP BY site)
SELECT a.site, pages, CAST(least(100, greatest(0, 25 - {d.half_up('round(b * 250, 6)')}) + greatest(0, 10 - {d.half_up('round(u * 100, 6)')}) + {d.half_up('round(10 * t + 10 * m, 6)')} + CASE WHEN n >= 40 THEN 10 WHEN n >= 20 THEN 7 WHEN n >= 10 THEN 4 ELSE 0 END + CASE WHEN home THEN 10 ELSE 0 END + CASE WHEN about THEN 5 ELSE 0 END
 + CASE WHEN sections >= 3 THEN 10 WHEN sections = 2 THEN 7 WHEN sections = 1 THEN 4 ELSE 0 END + greatest(0, 10 - {d.half_up('round(x * 50, 6)')}) + CASE WHEN discovered >= 20 THEN 10 WHEN discovered >= 10 THEN 7 WHEN discovered >= 3 THEN 4 ELSE 2 END) AS BIGINT) AS score FROM a JOIN st ON st.site = a.site""")
def llms_quality(spark: SparkSession, sf: str) -> DataFrame:
    return au.llms_quality(pq.derived(spark, sf, _ENTRY), pq.derived(spark, sf, _FILE))


_LINK = "'- [x](https://a.example/' || page_id || ')'"
_BODY = f"""SELECT 's' || page_id AS site, CASE page_id % 8 WHEN 0 THEN '# T' || chr(10) || '> about' || chr(10) || '## A' || chr(10) || {_LINK} || chr(10) || '## B' || chr(10) || '- [y](https://a.example/y)' WHEN 1 THEN '## A' || chr(10) || {_LINK} WHEN 2 THEN '# T' || chr(10) || '## A' || chr(10) || '## A' || chr(10) || {_LINK}
 WHEN 3 THEN '# T' || chr(10) || '> s' || chr(10) || '### Deep' || chr(10) || '## A' || chr(10) || '- no link' WHEN 4 THEN '# T' || chr(10) || '## A' || chr(10) || {_LINK} || chr(10) || '- [again](https://a.example/' || page_id || '/)' WHEN 5 THEN '# T' || chr(10) || '# U' || chr(10) || '## A' || chr(10) || '- [x](ftp://a.example/)' WHEN 6 THEN '' ELSE '# T' || chr(1) || chr(10) || '## A' END AS body FROM {{pg}}"""


@query(f"""WITH {pq._PG} SELECT 's' || page_id AS site, failed = '' AS valid, failed, warned, sections, links FROM pg JOIN (VALUES (0, '', '', 2, 2), (1, 'title', 'summary', 1, 1), (2, 'names,empty', 'summary', 2, 1), (3, 'headings,links', '', 1, 0), (4, 'repeats', 'summary', 1, 2), (5, 'title,links', 'summary', 1, 1), (6, 'title', 'summary', 0, 0), (7, 'empty,signs', 'summary', 1, 0)) AS v(k, failed, warned, sections, links) ON v.k = page_id % 8""")
def llms_checks(spark: SparkSession, sf: str) -> DataFrame:
    """C35; the expected values are worked out by hand for eight kinds of file."""
    return au.llms_checks(pq.derived(spark, sf, _BODY))


@query(f"""WITH {oq._NEW}, n AS (SELECT *, strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM nw WHERE rank <= 3 AND published IS NOT NULL)
SELECT site, count(*) AS items, '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>' || site || '</title><link rel="alternate" href="https://' || site || '/"/><id>https://' || site || '/</id><updated>' || max(stamp) || '</updated>'
 || string_agg('<entry><title>' || {oq._X.format('title')} || '</title><link rel="alternate" href="' || {oq._X.format('loc')} || '"/><id>' || {oq._X.format('loc')} || '</id><updated>' || stamp || '</updated><published>' || stamp || '</published></entry>', '' ORDER BY rank) || '</feed>' AS body FROM n GROUP BY site""")
def atom_feeds(spark: SparkSession, sf: str) -> DataFrame:
    return out.atom_feeds(out.newest(oq.items(spark, sf), 3).where("published is not null"))


_ROWS = f"""WITH {d.MAIN} SELECT page_id, site, title || ', "' || path || '"' AS label FROM f"""


def labels(spark, sf):
    return sq.features(spark, sf).select("page_id", "site", F.concat("title", F.lit(', "'), "path", F.lit('"')).alias("label"))


@query(_ROWS)
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """K1: files with a header, read again."""
    return out.exported(labels(spark, sf), "csv")


@query(_ROWS)
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """K2: a JSON object a line, read again."""
    return out.exported(labels(spark, sf), "json")


_WIDE = """SELECT site, CASE page_id % 9 WHEN 0 THEN 'TECH_NOINDEX' WHEN 1 THEN 'CONTENT_DUP_RATIO' WHEN 2 THEN 'POLICY_FINDING' WHEN 3 THEN 'TECH_HTTPS' WHEN 4 THEN 'ARCH_ORPHAN' ELSE 'OTHER' END AS id, CASE page_id % 6 WHEN 0 THEN 'content' WHEN 1 THEN 'trust' WHEN 2 THEN 'policy' WHEN 3 THEN 'ux' WHEN 4 THEN 'tech' ELSE 'perf' END AS category,
 CASE (page_id * 3 + n) % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'info' ELSE 'passed' END AS status, CASE WHEN page_id % 4 < 2 THEN 'Site' ELSE '/x' END AS page, CASE WHEN page_id % 5 > 0 THEN CAST(page_id % 5 AS INT) END AS weight,
 CASE WHEN page_id % 5 <> 1 THEN CAST(60 + page_id % 40 AS INT) END AS confidence, CASE WHEN page_id % 3 = 0 THEN '3/4' END AS affected FROM {pg}"""
_RATIO = f"""{pq._PG}, {pq._as('fi', _WIDE)}, {pq._as('iv', _INVENTORY)},
z AS (SELECT site, category, status, CAST(coalesce(weight, 3) AS DOUBLE) AS w, coalesce(confidence, 100) / 100 AS k, CASE status WHEN 'passed' THEN 1 WHEN 'low' THEN 0.85 WHEN 'medium' THEN 0.55 WHEN 'high' THEN 0.2 ELSE 0 END AS im, id IN ({d.names(au.SITE_WIDE)}) AS wide, page = 'Site' OR affected IS NOT NULL AS whole FROM fi WHERE status <> 'info'),
s AS (SELECT site, category, sum(w * im * k) FILTER (wide AND whole) / sum(w) FILTER (wide AND whole) AS r, sum(w) FILTER (NOT wide AND status = 'passed') AS plus, sum(w * (1 - im) * k) FILTER (NOT wide AND status <> 'passed') AS minus FROM z GROUP BY ALL),
y AS (SELECT iv.*, v.category, v.most, r, CASE WHEN coalesce(plus, 0) + coalesce(minus, 0) > 0 THEN coalesce(plus, 0) / (coalesce(plus, 0) + coalesce(minus, 0)) END AS p FROM iv CROSS JOIN (VALUES ('content', 25), ('trust', 20), ('policy', 20), ('ux', 15), ('tech', 10), ('perf', 10)) AS v(category, most) LEFT JOIN s ON s.site = iv.site AND s.category = v.category),
q AS (SELECT *, CASE WHEN r IS NOT NULL AND p IS NOT NULL THEN 0.7 * r + 0.3 * p WHEN r IS NOT NULL THEN r WHEN p IS NOT NULL THEN 0.4 + 0.6 * p ELSE 0.65 END AS raw, CASE WHEN category <> 'content' THEN 1 WHEN content_pages = 0 THEN 0.25 WHEN content_pages < 3 THEN 0.55 WHEN useful_pct < 20 THEN 0.4 WHEN useful_pct < 35 THEN 0.45 WHEN thin_pct >= 50 OR dup_pct >= 40 THEN 0.5 ELSE 1 END AS cap FROM y),
cs AS (SELECT site, category, CAST({d.half_up('round(least(raw, cap), 9) * 100')} AS BIGINT) AS pct, CAST({d.half_up('round(round(least(raw, cap), 9) * most, 6)')} AS BIGINT) AS score FROM q)"""


@query(f"WITH {_RATIO} SELECT * FROM cs")
def ratio_scores(spark: SparkSession, sf: str) -> DataFrame:
    return au.ratio_scores(pq.derived(spark, sf, _WIDE), pq.derived(spark, sf, _INVENTORY))


@query(f"""WITH {_RATIO}, t AS (SELECT site, CAST(sum(score) AS BIGINT) AS t FROM cs GROUP BY site), m AS (SELECT site, bool_or(category = 'policy' AND status = 'critical') AS a, count(*) FILTER (category = 'policy' AND status = 'high') AS b, bool_or(id = 'TECH_NOINDEX' AND page = 'Site') AS i, bool_or(id = 'TECH_HTTPS' AND status <> 'passed') AS h FROM fi GROUP BY site),
w AS (SELECT iv.site, least(t, CASE WHEN a THEN 20 ELSE 100 END, CASE WHEN i THEN 10 ELSE 100 END, CASE WHEN b >= 3 AND NOT a THEN 40 ELSE 100 END) AS t1, h, CASE WHEN content_pages < 3 THEN 100 WHEN useful_pct < 20 THEN 40 WHEN thin_pct >= 60 THEN 50 ELSE 100 END AS c FROM t JOIN m ON m.site = t.site JOIN iv ON iv.site = t.site),
e AS (SELECT site, CAST(least(CASE WHEN h THEN least(t1, greatest(t1 - 12, 25)) ELSE t1 END, c) AS BIGINT) AS total FROM w) SELECT site, total, CASE WHEN total < 40 THEN 'Not Ready' WHEN total < 65 THEN 'Needs Improvement' WHEN total < 80 THEN 'Almost Ready' ELSE 'Likely Ready' END AS verdict FROM e""")
def ratio_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    findings, inventory = pq.derived(spark, sf, _WIDE), pq.derived(spark, sf, _INVENTORY)
    return au.ratio_verdicts(au.ratio_scores(findings, inventory), findings, inventory)


_MARKS = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN array('Home', 'API Docs') WHEN 1 THEN array('Our Team') ELSE array() END AS crumbs, CASE page_id % 5 WHEN 0 THEN array('product', 'article') WHEN 1 THEN array('faqpage') ELSE array() END AS types,
 CASE page_id % 6 WHEN 0 THEN 'article' WHEN 1 THEN 'product.item' ELSE '' END AS og_type, CASE page_id % 4 WHEN 0 THEN array('Help') WHEN 1 THEN array('Latest news', 'Guides') ELSE array() END AS labels, CASE page_id % 3 WHEN 0 THEN 'A guide | Tools' WHEN 1 THEN 'About us' ELSE '' END AS headings FROM {pg}"""
_RULE = ", ".join(f"({k}, '{n}', [{d.names(s.split())}], [{d.names(c.split(','))}], '(?i){t}', '{v}')" for k, (n, s, c, t, v) in enumerate(ca.CATEGORIES))
_TYPE_OF = ", ".join(f"('{t}', '{c}')" for t, c in ca.TYPES.items())


@query(f"""WITH {d.MAIN}, mk AS ({_MARKS.replace('{pg}', 'f').replace("array()", "CAST([] AS VARCHAR[])").replace("array('", "list_value('")}), ru AS (SELECT * FROM (VALUES {_RULE}) AS v(k, cat, segs, keys, title_p, nav_p)), ty AS (SELECT * FROM (VALUES {_TYPE_OF}) AS v(t, cat)),
sg AS (SELECT page_id, unnest(x) AS s, unnest(range(0, len(x))) AS i FROM (SELECT page_id, [y for y in string_split(lower(path), '/') if y <> ''] AS x FROM f) AS a), tt AS (SELECT page_id, unnest(types) AS t, unnest(range(0, len(types))) AS i FROM mk), nv AS (SELECT page_id, min(k) AS k FROM mk, ru WHERE regexp_matches(lower(array_to_string(labels, ' | ')), nav_p) GROUP BY page_id),
vo AS (SELECT page_id, cat, 4 AS w, i AS o FROM sg JOIN ru ON list_contains(segs, s) UNION ALL SELECT page_id, cat, 3, 1000 + k FROM mk, ru WHERE len([c for c in crumbs if len([q for q in keys if contains(lower(c), q)]) > 0]) > 0 UNION ALL SELECT page_id, cat, 5, 2000 + i FROM tt JOIN ty USING (t)
 UNION ALL SELECT page_id, CASE og_type WHEN 'article' THEN 'Blog' ELSE 'Products' END, 3, 3000 FROM mk WHERE og_type <> '' UNION ALL SELECT page_id, cat, 2, 4000 + k FROM mk, ru WHERE regexp_matches(headings, title_p) UNION ALL SELECT page_id, cat, 2, 5000 + k FROM f, ru WHERE regexp_matches(title, title_p) UNION ALL SELECT page_id, cat, 4, 6000 FROM nv JOIN ru ON ru.k = nv.k),
r AS (SELECT page_id, cat, sum(w) AS votes, row_number() OVER (PARTITION BY page_id ORDER BY sum(w) DESC, cat = 'Documentation' DESC, min(o)) AS r FROM vo GROUP BY page_id, cat)
SELECT f.page_id, CASE WHEN path IN ('', '/') THEN 'Home' ELSE coalesce(cat, 'Other') END AS category, CAST(CASE WHEN path IN ('', '/') THEN 0 ELSE coalesce(votes, 0) END AS INT) AS votes FROM f LEFT JOIN r ON r.page_id = f.page_id AND r.r = 1""")
def llms_categories(spark: SparkSession, sf: str) -> DataFrame:
    """C2; breadcrumbs, types, labels and headings follow from the page's number."""
    f = sq.features(spark, sf).select("page_id", "path", "title", urls.segments(F.col("url")).alias("segments"))
    return ca.categories(f.join(pq.derived(spark, sf, _MARKS), "page_id"))


_PAINT = "SELECT event_id AS load_id, value * 40 AS paint, CASE WHEN event_id % 5 <> 0 THEN value * 3 END AS ttfb, CASE WHEN event_id % 3 <> 0 THEN value * (event_id % 11) END AS start, CASE WHEN event_id % 7 <> 0 THEN value * (event_id % 13) END AS duration FROM {ev}"


@query(f"""WITH l AS ({_PAINT.replace('{ev}', 'events')}), x AS (SELECT *, CASE WHEN start IS NOT NULL THEN {d.half_up('greatest(0, start - coalesce(ttfb, 0))', 1)} END AS load_delay, CASE WHEN start IS NOT NULL THEN {d.half_up('duration', 1)} END AS load_duration, CASE WHEN start IS NOT NULL THEN {d.half_up('greatest(0, paint - start - coalesce(duration, 0))', 1)} END AS render_delay, {d.half_up('ttfb', 1)} AS t FROM l)
SELECT load_id, load_delay, load_duration, render_delay, CASE WHEN load_delay IS NULL OR load_duration IS NULL OR render_delay IS NULL THEN NULL WHEN t >= greatest(load_delay, load_duration, render_delay) THEN 'TTFB' WHEN load_delay >= greatest(load_duration, render_delay) THEN 'Load delay' WHEN load_duration >= render_delay THEN 'Load duration' ELSE 'Render delay' END AS bottleneck FROM x""")
def load_phases(spark: SparkSession, sf: str) -> DataFrame:
    rows = ca.load_phases(spark.sql(_PAINT, ev=read_table(spark, sf, "events")))
    return rows.select("load_id", "load_delay", "load_duration", "render_delay", "bottleneck")


_LOAD = """SELECT event_id AS load_id, CASE WHEN event_id % 4 = 0 THEN 'lazy' ELSE 'eager' END AS loading, event_id % 3 = 0 AS in_viewport, event_id % 5 = 0 AS preloaded, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE '' END AS fetchpriority, CASE WHEN event_id % 7 <> 0 THEN 100 * (event_id % 9) END AS natural_w, 100 * (event_id % 4) AS rendered_w, 1000 * (event_id % 1000) AS bytes,
 CASE event_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' ELSE 'jpg' END AS format, CASE WHEN event_id % 11 <> 0 THEN event_id % 7000 END AS nodes, event_id % 60 AS depth, value AS longest_frame, event_id % 9 AS long_tasks FROM {ev}"""


@query(f"""WITH l AS ({_LOAD.replace('{ev}', 'events')}) SELECT load_id, i.issue, i.severity FROM l, LATERAL (VALUES ('lcp-lazy', 'critical', load_id % 12 = 0), ('lcp-priority', 'high', load_id % 5 <> 0 AND load_id % 2 = 1), ('lcp-oversized', 'high', load_id % 7 <> 0 AND load_id % 4 > 0 AND load_id % 9 > 2 * (load_id % 4)), ('lcp-format', 'medium', load_id % 1000 > 512 AND load_id % 3 <> 1),
 ('dom-very-large', 'high', nodes > 5000), ('dom-large', 'medium', nodes BETWEEN 1501 AND 5000), ('dom-deep', 'low', load_id % 60 > 40), ('loaf', 'medium', longest_frame > 200), ('mainthread-busy', 'medium', load_id % 9 > 5)) AS i(issue, severity, holds) WHERE i.holds""")
def load_issues(spark: SparkSession, sf: str) -> DataFrame:
    return ca.load_issues(spark.sql(_LOAD, ev=read_table(spark, sf, "events")))
