"""Queries on crawler rules, page classes and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators import classify as cl
from pagelode.operators import links as lk
from pagelode.operators import pages as pg
from pagelode.operators import robots as rb
from pagelode.plans import duck as d
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


def bots(spark):
    return spark.createDataFrame(list(rb.BOTS), "token string, organization string, purpose string")


def robots_files(spark, sf):
    """A robots file for each site of the corpus, from its own paths."""
    p = read_table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), urls.path(F.col("url")).alias("path"), urls.segments(F.col("url"))[0].alias("seg"))
    s = p.groupBy("site").agg(F.min("path").alias("p"), F.min("seg").alias("seg"), F.count("*").alias("n"))
    text = F.concat(F.lit("User-agent: *\nDisallow: /"), "seg", F.lit("/\nAllow: "), "p", F.lit("\nDisallow: /*.html$\n# crawlers\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /"), F.when(F.col("n") % 2 == 0, "private/").otherwise(""), F.lit("\nDisallow: /old/\n"))
    return s.select("site", text.alias("body"))


_S = f"""{d.PAGE}, si AS (SELECT site, min(path) AS p, min(regexp_extract(lower(path), '^/*([^/]+)', 1)) AS seg, count(*) AS n FROM h GROUP BY site),
ru AS (SELECT site, 1 AS group_id, '*' AS agent, 'disallow' AS type, '/' || seg || '/' AS path, 2 AS line FROM si UNION ALL SELECT site, 1, '*', 'allow', p, 3 FROM si UNION ALL SELECT site, 1, '*', 'disallow', '/*.html$', 4 FROM si
 UNION ALL SELECT site, 2, a, 'disallow', CASE WHEN n % 2 = 0 THEN '/private/' ELSE '/' END, 8 FROM si CROSS JOIN (VALUES ('gptbot'), ('ccbot')) AS t(a) UNION ALL SELECT site, 2, a, 'disallow', '/old/', 9 FROM si CROSS JOIN (VALUES ('gptbot'), ('ccbot')) AS t(a)),
bo AS (SELECT * FROM (VALUES {', '.join(str(b) for b in rb.BOTS)}) AS t(token, organization, purpose))"""


def rules(spark, sf):
    return rb.parse_robots(robots_files(spark, sf))


@query(f"WITH {_S} SELECT site, CAST(group_id AS BIGINT) AS group_id, agent, type, path, line FROM ru")
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules(spark, sf)


@query(f"""WITH {_S}, pa AS (SELECT DISTINCT site, path FROM h),
ask AS (SELECT pa.site, pa.path, bo.token, CASE WHEN lower(token) IN ('gptbot', 'ccbot') THEN lower(token) ELSE '*' END AS agent FROM pa CROSS JOIN bo),
m AS (SELECT ask.*, ru.type, ru.path AS rule FROM ask LEFT JOIN ru ON ru.site = ask.site AND ru.agent = ask.agent AND (CASE WHEN ru.path = '/*.html$' THEN ask.path LIKE '%.html' ELSE starts_with(ask.path, ru.path) END)),
k AS (SELECT *, row_number() OVER (PARTITION BY site, path, token ORDER BY length(rule) DESC NULLS LAST, type, rule) AS r FROM m)
SELECT site, path, token, CASE WHEN type = 'disallow' THEN 'blocked' ELSE 'allowed' END AS verdict, coalesce(rule, '') AS rule FROM k WHERE r = 1""")
def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages").select(urls.site(F.col("url")).alias("site"), urls.path(F.col("url")).alias("path"))
    return rb.verdicts(rules(spark, sf), p, bots(spark))


@query(f"""WITH {_S}, x AS (SELECT site, agent, path, count(*) AS n, count(DISTINCT type) AS k, bool_or(type = 'disallow') AS dis FROM ru GROUP BY site, agent, path)
SELECT site, agent, path, 'conflict' AS issue FROM x WHERE k > 1 UNION ALL SELECT site, agent, path, 'duplicate' FROM x WHERE n > 1 AND k = 1
UNION ALL SELECT site, agent, path, 'redundant' FROM x WHERE dis AND path <> '/' AND EXISTS (SELECT 1 FROM ru WHERE ru.site = x.site AND ru.agent = x.agent AND ru.type = 'disallow' AND ru.path = '/')""")
def robots_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return rb.conflicts(rules(spark, sf))


@query(f"""WITH {_S}, ag AS (SELECT DISTINCT site, agent FROM ru), x AS (SELECT site, count(*) AS named FROM ag JOIN bo ON lower(token) = agent GROUP BY site), y AS (SELECT site, bool_or(agent = '*') AS star FROM ag GROUP BY site)
SELECT si.site, coalesce(named, 0) AS explicit, CASE WHEN star THEN {len(rb.BOTS)} - coalesce(named, 0) ELSE 0 END AS wildcard, CASE WHEN star THEN 0 ELSE {len(rb.BOTS)} - coalesce(named, 0) END AS none FROM si LEFT JOIN x ON x.site = si.site JOIN y ON y.site = si.site""")
def crawler_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r = rules(spark, sf)
    out = rb.coverage(r, r, bots(spark))
    return out.select("site", *[F.col(c).cast("long").alias(c) for c in ("explicit", "wildcard", "none")])


@query(f"""WITH {_S}, a AS (SELECT site, token, CASE WHEN lower(token) IN ('gptbot', 'ccbot') THEN lower(token) ELSE '*' END AS agent FROM si CROSS JOIN bo),
m AS (SELECT a.site, token, a.agent, arg_max(type, (length(ru.path), type = 'allow')) AS type FROM a LEFT JOIN ru ON ru.site = a.site AND ru.agent = a.agent AND starts_with('/', ru.path) GROUP BY a.site, token, a.agent)
SELECT site, token, CASE WHEN type = 'disallow' THEN 'blocked' WHEN agent <> '*' THEN 'mentioned' ELSE 'allowed' END AS state FROM m""")
def ai_access(spark: SparkSession, sf: str) -> DataFrame:
    r = rules(spark, sf)
    return rb.ai_access(r, r.select("site").distinct(), bots(spark))


def modes(spark, sf):
    n = read_table(spark, sf, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"))
    return n.select("site", F.when(F.col("n") % 4 == 0, "open").when(F.col("n") % 4 == 1, "closed").when(F.col("n") % 4 == 2, "no_training").otherwise("none").alias("mode"))


_POLICY = f"""{_S}, po AS (SELECT site, token, purpose, CASE n % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN CASE WHEN purpose = 'training' THEN 'block' ELSE 'allow' END ELSE 'default' END AS decision FROM si CROSS JOIN bo)"""


@query(f"WITH {_POLICY} SELECT * FROM po")
def crawler_policy(spark: SparkSession, sf: str) -> DataFrame:
    return rb.policy(modes(spark, sf), bots(spark))


@query(f"""WITH {_POLICY} SELECT site, string_agg('User-agent: ' || token || chr(10) || CASE decision WHEN 'block' THEN 'Disallow: /' ELSE 'Allow: /' END || chr(10), chr(10) ORDER BY token) AS body FROM po WHERE decision <> 'default' GROUP BY site""")
def robots_text(spark: SparkSession, sf: str) -> DataFrame:
    return rb.robots_text(rb.policy(modes(spark, sf), bots(spark)))


_UA = f"""bo AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {', '.join(str(b) for b in rb.BOTS)}) AS t(token, organization, purpose)),
ev AS (SELECT event_id, user_id, CASE WHEN user_id % {len(rb.BOTS) + 3} < {len(rb.BOTS)} THEN (SELECT token FROM bo WHERE i = user_id % {len(rb.BOTS) + 3}) WHEN user_id % {len(rb.BOTS) + 3} = {len(rb.BOTS)} THEN 'xGPTBot' WHEN user_id % {len(rb.BOTS) + 3} = {len(rb.BOTS) + 1} THEN 'GPTBot) CCBot' ELSE 'Chrome' END AS t FROM events)"""


def agents(spark, sf):
    names = F.array(*[F.lit(b[0]) for b in rb.BOTS], F.lit("xGPTBot"), F.lit("GPTBot) CCBot"), F.lit("Chrome"))
    ua = F.concat(F.lit("Mozilla/5.0 (compatible; "), F.get(names, (F.col("user_id") % (len(rb.BOTS) + 3)).cast("int")), F.lit("/1.0)"))
    return rb.match_agents(read_table(spark, sf, "events").select("event_id", "user_id", ua.alias("ua")), [b[0] for b in rb.BOTS])


@query(f"WITH {_UA} SELECT event_id, CAST(CASE WHEN t = 'GPTBot) CCBot' THEN 2 WHEN t IN ('xGPTBot', 'Chrome') THEN 0 ELSE 1 END AS BIGINT) AS bots, CASE WHEN t NOT IN ('GPTBot) CCBot', 'xGPTBot', 'Chrome') THEN t END AS token FROM ev")
def agent_matches(spark: SparkSession, sf: str) -> DataFrame:
    return agents(spark, sf).select("event_id", "bots", "token")


@query(f"WITH {_UA} SELECT purpose, count(*) AS hits, count(DISTINCT user_id) AS clients FROM ev JOIN bo ON bo.token = ev.t GROUP BY purpose")
def crawler_traffic(spark: SparkSession, sf: str) -> DataFrame:
    rows = agents(spark, sf).where("token is not null").join(F.broadcast(bots(spark)), "token")
    return rows.groupBy("purpose").agg(F.count("*").alias("hits"), F.count_distinct("user_id").alias("clients"))


STATUS = "CASE page_id % 11 WHEN 3 THEN 404 WHEN 5 THEN 301 WHEN 7 THEN 500 WHEN 9 THEN 403 ELSE 200 END"
_NOINDEX = "(page_id % 17 = 4)"


def facts(spark, sf):
    """Page features with fetch facts that follow from the page's number."""
    f = sq.features(spark, sf)
    return f.withColumns({"status": F.expr(STATUS), "blocked": F.expr("page_id % 13 = 2"), "content_type": F.expr("CASE WHEN page_id % 19 = 6 THEN 'application/pdf' ELSE 'text/html' END"), "noindex": F.expr(f"noindex OR {_NOINDEX}"), "params": F.size(urls.pairs(F.col("url"))), "tracking": urls.has_tracking(F.col("url")), "segs": urls.segments(F.col("url"))})


_FACTS = f"""{d.MAIN},
fa AS (SELECT f.page_id, f.site, f.path, f.scheme, f.title, regexp_extract(f.html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(f.html, '(?i)<h1[\\s>]')) AS h1_count, len(regexp_extract_all(f.html, '(?i)<p[\\s>]')) AS paragraphs,
 len({d.words('main')}) AS word_count, octet_length(encode(f.html)) AS html_bytes, regexp_matches(f.html, '(?i)name="viewport"') AS has_viewport, regexp_matches(f.html, '(?i)<nav[\\s>]') AS has_nav, regexp_matches(f.html, '(?i)<footer[\\s>]') AS has_footer,
 regexp_extract(f.html, '(?i)<html[^>]*\\blang="([^"]*)"', 1) AS lang, len(regexp_extract_all(f.html, '(?i)class="[^"]*\\bad\\b')) AS ad_slots, '' AS canonical, {STATUS.replace('page_id', 'f.page_id')} AS status, (f.page_id % 13 = 2) AS blocked,
 CASE WHEN f.page_id % 19 = 6 THEN 'application/pdf' ELSE 'text/html' END AS content_type, {_NOINDEX.replace('page_id', 'f.page_id')} AS noindex, len([p for p in string_split(h.query, '&') if p <> '']) AS params, h.query AS query FROM f JOIN h ON f.page_id = h.page_id)"""


@query(f"WITH {_FACTS} SELECT page_id, {cl.INDEXABILITY} AS verdict FROM fa")
def indexability(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("page_id", F.expr(cl.INDEXABILITY).alias("verdict"))


@query(f"WITH {_FACTS}, v AS (SELECT {cl.INDEXABILITY} AS reason FROM fa) SELECT reason, count(*) AS pages FROM v WHERE reason <> 'Indexable' GROUP BY reason")
def exclusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = facts(spark, sf).select(F.expr(cl.INDEXABILITY).alias("reason"))
    return v.where("reason <> 'Indexable'").groupBy("reason").agg(F.count("*").alias("pages"))


@query(f"""WITH {_FACTS} SELECT page_id, CASE WHEN len([p for p in string_split(query, '&') if lower(string_split(p, '=')[1]) in ({d.names(urls.TRACKING)})]) > 0 THEN 'Tracking' WHEN params >= 2 THEN 'Parameters' END AS reason FROM fa""")
def suitability(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("page_id", cl.suitability(F.col("segs"), F.col("params"), F.col("tracking")).alias("reason"))


@query(f"WITH {_FACTS} SELECT page_id, {cl.PAGE_TYPE} AS page_type FROM fa")
def page_types(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("page_id", F.expr(cl.PAGE_TYPE).alias("page_type"))


_FOUND = f"""{_FACTS}, fi AS ({' UNION ALL '.join(f"SELECT site, page_id, '{c}' AS check, '{g}' AS grp, '{s}' AS severity, {w} AS weight FROM fa WHERE {p}" for c, g, p, s, w in cl.CHECKS)})""".replace("AS check,", 'AS "check",')


@query(f"WITH {_FOUND} SELECT * FROM fi")
def seo_findings(spark: SparkSession, sf: str) -> DataFrame:
    return cl.findings(facts(spark, sf))


@query(f"""WITH {_FACTS}, va AS ({' UNION ALL '.join(f"SELECT site, '{g}' AS grp, {w} AS weight, CASE WHEN {p} THEN {60 if s == 'warning' else 0} ELSE 100 END AS value FROM fa" for c, g, p, s, w in cl.CHECKS)}),
sc AS (SELECT site, grp, {d.half_up('CAST(sum(weight * value) AS DOUBLE) / sum(weight)')} AS score FROM va GROUP BY GROUPING SETS ((site, grp), (site))) SELECT *, {cl.GRADE} AS grade FROM sc""")
def seo_scores(spark: SparkSession, sf: str) -> DataFrame:
    return cl.check_scores(facts(spark, sf))


_GROUPS = sorted({g for _, g, *_ in cl.CHECKS})


@query(f"WITH {_FOUND} SELECT site, page_id, {', '.join(f'''count(*) FILTER (grp = '{g}') AS {g}''' for g in _GROUPS)} FROM fi GROUP BY site, page_id")
def issue_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return cl.issue_matrix(cl.findings(facts(spark, sf)))


@query(f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, weight DESC, "check", page_id) AS rank FROM fi) SELECT site, CAST(rank AS INTEGER) AS rank, page_id, "check" FROM r WHERE rank <= 40""")
def priority_list(spark: SparkSession, sf: str) -> DataFrame:
    return cl.priorities(cl.findings(facts(spark, sf)))


@query(f"WITH {_FOUND} SELECT grp, severity, count(*) AS n FROM fi GROUP BY GROUPING SETS ((grp), (severity))")
def finding_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return cl.histograms(cl.findings(facts(spark, sf)))


def importance(spark, sf):
    e = sq.edges(spark, sf)
    degree = lk.degrees(e, sq.features(spark, sf)).drop("site")
    rows = facts(spark, sf).join(degree, "page_id").join(sq.depths(spark, sf, e), "page_id", "left")
    typed = rows.withColumn("page_type", F.expr(cl.PAGE_TYPE)).withColumn("depth", F.coalesce("depth", F.lit(9)))
    return typed.select("site", "page_id", "page_type", F.expr(cl.IMPORTANCE).cast("long").alias("importance"))


_IMP = f"""{_FACTS}, {d.EDGES[len(d.PAGE) + 2:]}, xe AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), {sq._DEPTH},
im AS (SELECT site, page_id, page_type, CAST({cl.IMPORTANCE} AS BIGINT) AS importance FROM (SELECT fa.*, {cl.PAGE_TYPE} AS page_type, coalesce(dp.depth, 9) AS depth, (SELECT count(*) FROM xe WHERE xe.dst = fa.page_id) AS in_links FROM fa LEFT JOIN dp ON dp.page_id = fa.page_id))"""


@query(f"WITH RECURSIVE {_IMP} SELECT site, page_id, importance, {cl.BAND} AS band FROM im")
def page_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance(spark, sf).select("site", "page_id", "importance", F.expr(cl.BAND).alias("band"))


CAPS = (("important", 2), ("guide", 2), ("article", 3), ("post", 2))


@query(f"""WITH RECURSIVE {_IMP}, i AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY importance DESC, page_id) AS r FROM im), b AS (SELECT *, row_number() OVER (PARTITION BY site, page_type ORDER BY importance DESC, page_id) AS k FROM i WHERE r > 2)
SELECT site, 'important' AS section, CAST(r AS INTEGER) AS rank, page_id FROM i WHERE r <= 2 UNION ALL SELECT site, page_type, CAST(k AS INTEGER), page_id FROM b WHERE (page_type = 'guide' AND k <= 2) OR (page_type = 'article' AND k <= 3) OR (page_type = 'post' AND k <= 2)""")
def llms_sections(spark: SparkSession, sf: str) -> DataFrame:
    return cl.sections(importance(spark, sf), CAPS)


@query(f"""WITH {_FOUND}, n AS (SELECT site, count(*) AS pages FROM fa GROUP BY site), p AS (SELECT site, "check", severity, weight, count(DISTINCT page_id) AS hit FROM fi GROUP BY ALL),
g AS (SELECT p.site, sum(CAST(weight * hit AS DOUBLE) / n.pages) AS lost, max(CASE WHEN severity = 'critical' THEN CAST(hit AS DOUBLE) / n.pages END) AS critical FROM p JOIN n ON p.site = n.site GROUP BY p.site),
s AS (SELECT n.site, n.pages, coalesce({d.half_up('CASE WHEN critical >= 0.5 THEN least(greatest(0.0, 100 - lost), 55.0) ELSE greatest(0.0, 100 - lost) END')}, 100.0) AS score FROM n LEFT JOIN g ON n.site = g.site)
SELECT *, CASE WHEN score >= 70 THEN 'ready' WHEN score >= 40 THEN 'needs work' ELSE 'not ready' END AS verdict FROM s""")
def eligibility_score(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return cl.eligibility(cl.findings(f), f)
