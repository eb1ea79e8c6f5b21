"""Queries of the search audit. Answers of servers and robots files follow from the numbers of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelode.operators import pages as pg
from pagelode.operators import seo_audit as seo
from pagelode.operators.lineage import checkpoint
from pagelode.plans import duck as d
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


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _all(pattern: str, g: int = 0, x: str = "f.html") -> str:
    return f"regexp_extract_all({x}, '{_q(pattern)}', {g})"


def _len(values: str, keep: str = "true") -> str:
    return f"len([x for x in {values} if {keep}])"


def _meta(name: str) -> str:
    return f"""trim(regexp_extract(f.html, '(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)', 1))"""


_HREF = r"""regexp_extract(x, '(?i)\bhref=["'']([^"'']*)', 1)"""
_OUT = r"(regexp_matches({0}, '(?i)^(?:https?:)?//') AND NOT contains(lower({0}), site))"
_ANCHOR_OUT, _URL_OUT = _OUT.format(_HREF), _OUT.format("x")


def _rx(pattern: str, x: str = "x") -> str:
    return f"regexp_matches({x}, '{_q(pattern)}')"


ROBOTS = "SELECT site, c % 3 <> 0 AS has_robots, c % 11 = 0 AS blocks_all, c % 2 = 0 AS has_sitemap, CASE c % 3 WHEN 0 THEN 'br' WHEN 1 THEN 'gzip' ELSE '' END AS encoding, CASE WHEN c % 4 = 0 THEN '' ELSE 'max-age=60' END AS cache_control, CASE WHEN c % 5 <> 0 THEN c * 100 END AS ms, " + ", ".join(
    f"c % {k + 2} = 0 AS {name}" for k, name in enumerate(("hsts", "csp", "frame_options", "type_options", "referrer_policy", "permissions_policy", "gptbot", "claudebot", "perplexitybot", "google_extended"))
) + " FROM {pg} WHERE n = 1"
_FACTS = f"""{sq._KEYWORDS}, pg AS (SELECT site, page_id, url, path, html, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n, count(*) OVER (PARTITION BY site) AS c FROM h), {pq._FE}, {pq._as('rb', ROBOTS)},
r0 AS (SELECT f.page_id, f.site, f.url, f.path, f.scheme, f.html, f.title, f.main, {d.visible('f.html')} AS visible, {d.words('f.main')} AS w, {_all(r'(?i)<img' + chr(92) + 'b[^>]*>')} AS im, {_all(r'(?is)<a' + chr(92) + 'b[^>]*' + chr(92) + 'bhref=.*?</a>')} AS an, [CAST(x AS INT) for x in {_all('(?i)<h([1-6])[' + chr(92) + 's>]', 1)}] AS lv,
  lower({_meta('robots')}) AS rm, regexp_extract(f.html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS can, {_all('(?is)<script[^>]*application/ld' + chr(92) + '+json[^>]*>(.*?)</script>', 1)} AS ld, {_all('(?i)<link[^>]*hreflang="([^"]*)"', 1)} AS al,
  {d.plain("regexp_extract(f.html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, kw.word AS kw, coalesce(kw.uses, 0) AS ku, fe.status FROM f JOIN fe ON fe.page_id = f.page_id LEFT JOIN rk AS kw ON kw.page_id = f.page_id AND kw.rank = 1),
r1 AS (SELECT *, CAST({sq._SYL} AS DOUBLE) AS sy, greatest(1, len({_all('[^.!?]+[.!?]+', x='main')})) AS se FROM r0),
pf AS (SELECT page_id, site, url, path, scheme, status, title, regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) AS lang, regexp_matches(html, '(?i)<meta[^>]*noindex') OR contains(rm, 'noindex') AS noindex, contains(rm, 'nofollow') AS nofollow, {_meta('description').replace('f.html', 'html')} AS description,
  regexp_replace(can, '/$', '') AS canonical, regexp_replace(url, '/$', '') AS own_url, contains(can, site) AS own_canonical, {_len('lv', 'x = 1')} AS h1s, {_len('lv', 'x = 2')} AS h2s, len(lv) AS headings, len([i for i in range(1, len(lv) + 1) if lv[i] > (CASE WHEN i = 1 THEN 1 ELSE lv[i - 1] END) + 1]) > 0 AS skips,
  ku AS keyword_uses, coalesce(list_contains({d.words('lower(title)')}, kw), false) AS keyword_in_title, coalesce(list_contains({d.words('lower(h1)')}, kw), false) AS keyword_in_h1, len(w) AS words, {d.half_up('100.0 * octet_length(encode(visible)) / greatest(1, octet_length(encode(html)))')} AS ratio, length(main) AS text_length,
  CASE WHEN len(w) >= 8 THEN least(100, greatest(0, 206.835 - 1.015 * len(w) / se - 84.6 * sy / len(w))) ELSE 0 END AS flesch, len(im) AS images, {_len('im', 'NOT ' + _rx('(?i)' + chr(92) + 'balt' + chr(92) + 's*='))} AS no_alt, {_len('im', _rx('(?i)' + chr(92) + 'balt' + chr(92) + "s*=" + chr(92) + "s*(?:\"\"|'')"))} AS empty_alt,
  {_len('im', _rx('(?i)' + chr(92) + "bsrc=[\"'][^\"']*" + chr(92) + ".(?:webp|avif)"))} AS modern, {_len('im', _rx('(?i)' + chr(92) + "bloading=[\"']lazy"))} AS lazy, {_len('im', 'NOT ' + _rx('(?i)' + chr(92) + 'bwidth' + chr(92) + 's*=') + ' OR NOT ' + _rx('(?i)' + chr(92) + 'bheight' + chr(92) + 's*='))} AS unsized,
  {_len(_all('(?i)<script' + chr(92) + 'b[^>]*' + chr(92) + 'bsrc=[^>]*>', x="regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1)"), 'NOT ' + _rx('(?i)' + chr(92) + 'b(?:async|defer)' + chr(92) + 'b'))} AS blocking, {_len('list_distinct(' + _all('(?i)<script' + chr(92) + "b[^>]*?" + chr(92) + "bsrc=[\"']([^\"']*)", 1, 'html') + ')', _URL_OUT)} AS foreign_scripts,
  len({_all('(?i)fonts' + chr(92) + '.(?:googleapis|gstatic)|@font-face', x='html')}) AS fonts, {_meta('viewport').replace('f.html', 'html')} AS viewport, len(ld) AS schemas, {_len('ld', 'NOT json_valid(x)')} AS bad_schema, {_len('an', f"NOT {_ANCHOR_OUT} AND NOT regexp_matches({_HREF}, '(?i)^(?:#|mailto:|tel:|javascript:)')")} AS inner_links, {_len('an', _ANCHOR_OUT)} AS outer_links,
  {_len('an', f"NOT {_ANCHOR_OUT} AND {d.plain('x')} = '' AND NOT regexp_matches(x, '(?i)<img')")} AS empty_anchors, len(al) AS alternates, {_len('al', "NOT regexp_matches(x, '^(?:[a-z]{2,3}(?:-[A-Za-z0-9]+)?|x-default)$')")} AS bad_alternates, len({_all('(?i)@media', x='html')}) AS media_queries,
  len({_all('(?i)<(?:img|script)' + chr(92) + "b[^>]*" + chr(92) + "bsrc=[\"']http://|<link" + chr(92) + "b[^>]*stylesheet[^>]*" + chr(92) + "bhref=[\"']http://", x='html')}) AS mixed, {_len('an', _ANCHOR_OUT + ' AND ' + _rx('(?i)' + chr(92) + "brel=[\"'][^\"']*nofollow"))} AS nofollow_links, {_len('an', _rx('(?i)' + chr(92) + "brel=[\"'][^\"']*sponsored"))} AS sponsored_links,
  {_len('an', _ANCHOR_OUT + ' AND ' + _rx('(?i)' + chr(92) + "btarget=[\"']_blank") + ' AND NOT ' + _rx('(?i)' + chr(92) + "brel=[\"'][^\"']*(?:noopener|noreferrer)"))} AS open_tabs FROM r1)"""
_SITE = f"""{_FACTS}, ho AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length(path), page_id) AS r FROM pf), {', '.join(f"{name} AS (SELECT site, count(*) AS {name} FROM (SELECT site, {key} FROM pf WHERE {key} <> '' GROUP BY site, {key} HAVING count(*) > 1) AS x GROUP BY site)" for key, name in (('path', 'shared_paths'), ('title', 'shared_titles'), ('description', 'shared_descriptions')))},
ag AS (SELECT site, count(*) AS pages, count(*) FILTER (path LIKE '%/' AND path <> '/') AS slash_ends, count(*) FILTER (path <> '' AND path NOT LIKE '%/') AS bare_ends, sum(mixed) AS mixed, sum(nofollow_links) AS nofollow_links, sum(sponsored_links) AS sponsored_links, sum(open_tabs) AS open_tabs FROM pf GROUP BY site),
sf AS (SELECT ag.*, ho.scheme = 'https' AS https, ho.lang AS home_lang, ho.words AS home_words, ho.headings AS home_headings, ho.media_queries, coalesce(shared_paths, 0) AS shared_paths, coalesce(shared_titles, 0) AS shared_titles, coalesce(shared_descriptions, 0) AS shared_descriptions, rb.* EXCLUDE (site)
 FROM ag JOIN ho ON ho.site = ag.site AND ho.r = 1 JOIN rb ON rb.site = ag.site LEFT JOIN shared_paths AS a ON a.site = ag.site LEFT JOIN shared_titles AS b ON b.site = ag.site LEFT JOIN shared_descriptions AS c ON c.site = ag.site)"""


def _checked(table: str, rules, keys: str) -> str:
    return " UNION ALL ".join(f"""SELECT {keys}, '{g}' AS grp, '{c}' AS "check", {w} AS weight, {s} AS status FROM {table}""" for g, c, w, s in rules)


_PAGE_FOUND = f"SELECT * FROM ({_checked('pf', seo.PAGE_RULES, 'site, page_id')}) AS x WHERE status IS NOT NULL"
_SITE_FOUND = f"SELECT * FROM ({_checked('sf', seo.SITE_RULES, 'site')}) AS x WHERE status IS NOT NULL"


def facts(spark, sf):
    f, pages = sq.features(spark, sf), read_table(spark, sf, "pages")
    return seo.page_facts(f, pages, pq.derived(spark, sf, pq.FETCHED), pg.top_keywords(pg.page_tokens(f), 1))


def kept_facts(spark, sf):
    """The narrow rows of facts, written once, as pages and sites both read them and html is large."""
    return checkpoint(facts(spark, sf))


def page_checks(rows):
    return seo.checked(rows, seo.PAGE_RULES, "site", "page_id")


def site_checks(spark, sf, rows):
    return seo.checked(seo.site_facts(rows, pq.derived(spark, sf, ROBOTS)), seo.SITE_RULES, "site")


@query(f"WITH {_FACTS} {_PAGE_FOUND}")
def seo_page_checks(spark: SparkSession, sf: str) -> DataFrame:
    """C17 by page."""
    return page_checks(facts(spark, sf))


@query(f"WITH {_SITE} {_SITE_FOUND}")
def seo_site_checks(spark: SparkSession, sf: str) -> DataFrame:
    """C17 by site, with the headers of C16 and C36."""
    return site_checks(spark, sf, kept_facts(spark, sf))


@query(f"""WITH {_SITE}, al2 AS (SELECT site, grp, weight, status FROM ({_PAGE_FOUND}) AS y UNION ALL SELECT site, grp, weight, status FROM ({_SITE_FOUND}) AS z),
v AS (SELECT site, grp, weight, CASE status WHEN 'pass' THEN 100 WHEN 'warning' THEN 60 ELSE 0 END AS value FROM al2 WHERE status <> 'info'),
s AS (SELECT site, grp, count(*) AS checks, {d.half_up('CAST(sum(weight * value) AS DOUBLE) / sum(weight)')} AS score FROM v GROUP BY ROLLUP (site, grp) HAVING site IS NOT NULL)
SELECT *, {seo.GRADE} AS grade FROM s""")
def seo_audit_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept_facts(spark, sf)
    return seo.audit_scores(page_checks(rows).select("site", "grp", "weight", "status").unionAll(site_checks(spark, sf, rows).select("site", "grp", "weight", "status")))
