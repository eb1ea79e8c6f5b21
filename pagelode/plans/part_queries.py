"""Queries on feeds, picks and the parts of page loads; parts follow from events by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators import feed_parts as fp
from pagelode.operators import load_parts as lp
from pagelode.operators import outputs as out
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


def read_feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the RSS and the Atom feeds that sites' newest items make."""
    dated = out.newest(oq.items(spark, sf), 3).where("published is not null")
    bodies = oq.feeds(spark, sf).select(F.concat(F.lit("rss "), "site").alias("source"), "body").unionByName(out.atom_feeds(dated).select(F.concat(F.lit("atom "), "site").alias("source"), "body"))
    return fp.feed_items(bodies)


_READ = f"""{oq._NEW}, it AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY rank) - 1 AS pos, nullif(trim(title), '') AS title, loc, published FROM nw WHERE rank <= 3 AND published IS NOT NULL),
rd AS (SELECT 'rss ' || site AS source, 'rss2' AS format, pos, title, loc AS link, strftime(published, '%a, %d %b %Y %H:%M:%S GMT') AS published FROM it UNION ALL SELECT 'atom ' || site, 'atom', pos, title, loc, strftime(published, '%Y-%m-%dT%H:%M:%SZ') FROM it)"""


@query(f"WITH {_READ} SELECT source, format, CAST(pos AS INTEGER) AS pos, title, link, link AS guid, published FROM rd")
def feeds_read(spark: SparkSession, sf: str) -> DataFrame:
    return read_feeds(spark, sf).select("source", "format", "pos", "title", "link", "guid", "published")


@query(f"WITH {_READ} SELECT source, count(*) AS items, count(*) FILTER (title IS NULL) AS no_title, CAST(0 AS BIGINT) AS no_link, CAST(0 AS BIGINT) AS relative, count(*) - count(DISTINCT link) AS repeated_guid, CAST(0 AS BIGINT) AS undated FROM rd GROUP BY source")
def feed_validation(spark: SparkSession, sf: str) -> DataFrame:
    return fp.feed_validation(read_feeds(spark, sf))


#: A link element for each page's head, by page number.
HEAD = """CASE page_id % 5 WHEN 0 THEN '<link rel="alternate" type="application/rss+xml" href="/feed" title="All">' WHEN 1 THEN '<link href="https://feeds.example/atom.xml" rel="Alternate" type="application/atom+xml">'
 WHEN 2 THEN '<link rel="alternate" hreflang="fr" href="/fr">' WHEN 3 THEN '<link rel="stylesheet" type="text/xml" href="/x">' ELSE '' END"""


@query(f"""WITH {d.PAGE} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN scheme || '://' || host || '/feed' ELSE 'https://feeds.example/atom.xml' END AS feed, CASE WHEN page_id % 5 = 0 THEN 'All' ELSE '' END AS title FROM h WHERE page_id % 5 < 2""")
def feed_discovery(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url", F.concat(F.expr(HEAD), "html").alias("html"))
    return fp.feed_links(pages).select("page_id", "feed", "title")


_BARE = "regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)"
for _p in (r"(?s)<!\[CDATA\[.*?\]\]>", "(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>", *fp.BOILERPLATE, r"[\x00-\x1f\x7f]+"):
    _BARE = f"regexp_replace({_BARE}, '{_p}', ' ', 'g')"
_CLEAN = f"trim(regexp_replace(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')), '^[\\s.,;:!]+', ''))"


@query(f"""WITH {d.MAIN}, x AS (SELECT page_id, title, {d.plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, {_CLEAN} AS s FROM f), y AS (SELECT *, left(s, 80) AS head FROM x),
z AS (SELECT *, length(head) - instr(reverse(head), ' ') AS sp FROM y)
SELECT page_id, regexp_replace(coalesce(nullif(trim(title), ''), h1), '\\s+', ' ', 'g') AS title, CASE WHEN length(s) > 80 THEN regexp_replace(CASE WHEN instr(head, ' ') > 0 AND sp > 48 THEN left(head, sp) ELSE head END, '[,.:;!?]+$', '') || '…' ELSE s END AS description FROM z""")
def item_picks(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    h1, title = (tx.plain(F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) for t in ("h1", "title"))
    first = F.regexp_extract("html", r"(?is)<p[^>]*>(.*?)</p>", 1)
    return sq.pages(spark, sf).select("page_id", fp.picked_title(none, none, title, h1, none).alias("title"), fp.picked_description(none, none, first, 80).alias("description"))


#: Parts of a load for each event; a load is a user's.
ANSWERS = """SELECT user_id AS load_id, CASE event_id % 4 WHEN 0 THEN 'a.css' WHEN 1 THEN 'b.js?v=1' WHEN 2 THEN 'c.png' ELSE 'd' END AS url, CASE WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 = 0 THEN 301 ELSE 200 END AS status,
 CASE WHEN event_id % 4 = 3 THEN 'text/html' ELSE '' END AS content_type, CASE event_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'identity' END AS encoding, CASE WHEN event_id % 7 > 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS bytes, CASE WHEN event_id % 5 = 0 THEN 'h3' ELSE 'h2' END AS protocol FROM {ev}"""
FILES = """SELECT user_id AS load_id, CASE WHEN event_id % 2 = 0 THEN 'script' ELSE 'style' END AS kind, CASE WHEN event_id % 2 = 0 THEN concat('https://', CASE WHEN event_id % 6 = 0 THEN 'cdn.example' ELSE 'a.example' END, '/lib', CAST(event_id % 17 AS VARCHAR(9)), '-', CAST(event_id % 5 AS VARCHAR(9)), '.0.min.js') ELSE concat('https://a.example/s', CAST(event_id % 23 AS VARCHAR(9)), '.css') END AS url,
 CASE WHEN event_id % 7 > 0 THEN CAST(floor(value * 100) AS BIGINT) END AS bytes, event_id % 3 = 0 AS blocking, 'a.example' AS page_host FROM {ev}"""
FACES = "SELECT user_id AS load_id, CASE WHEN event_id % 9 > 0 THEN concat('F', CAST(event_id % 2 AS VARCHAR(9))) END AS family, CAST(100 * (event_id % 8 + 1) AS INT) AS weight, CASE event_id % 5 WHEN 0 THEN 'block' WHEN 1 THEN '' ELSE 'swap' END AS display FROM {ev}"
FONTS = "SELECT user_id AS load_id, CASE WHEN event_id % 3 = 0 THEN 'f.woff2?x' ELSE 'f.js' END AS url, CAST(floor(value * 200) AS BIGINT) AS bytes FROM {ev}"
IMAGES = """SELECT user_id AS load_id, concat('i', CAST(event_id AS VARCHAR(20)), CASE event_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.webp' ELSE '.PNG?x' END) AS src, CAST(floor(value * 5000) AS BIGINT) AS bytes, CAST(event_id % 2000 AS INT) AS natural_w, CASE WHEN event_id % 10 > 0 THEN 700 END AS rendered_w,
 CASE WHEN event_id % 4 = 0 THEN 'lazy' END AS loading, event_id % 3 = 0 AS in_viewport, event_id % 5 > 0 AS has_dimensions FROM {ev}"""


def parts(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text, ev=read_table(spark, sf, "events"))


def _in(name: str, text: str) -> str:
    return f"{name} AS ({text.replace('{ev}', 'events')})"


_PLAIN = "lower(coalesce(encoding, '')) IN ('', 'identity')"
_TEXT = f"(regexp_matches(lower(coalesce(content_type, '')), '{lp.TEXT_TYPE}') OR regexp_matches(coalesce(url, ''), '{lp.TEXT_URL}'))"


@query(f"""WITH {_in('an', ANSWERS)} SELECT load_id, count(*) AS answers, count(*) FILTER (status BETWEEN 200 AND 299) AS ok, count(*) FILTER (status BETWEEN 300 AND 399) AS redirected, count(*) FILTER (status >= 400) AS failed, count(*) FILTER ({_TEXT}) AS text,
 count(*) FILTER ({_TEXT} AND NOT {_PLAIN}) AS compressed, count(*) FILTER ({_TEXT} AND {_PLAIN} AND (bytes IS NULL OR bytes > {lp.WORTH})) AS worth_it, array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols FROM an GROUP BY load_id""")
def answer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return lp.answer_coverage(parts(spark, sf, ANSWERS))


@query(f"""WITH {_in('fi', FILES)}, s AS (SELECT DISTINCT load_id, coalesce(nullif(lower(regexp_extract(url, '(?i){lp.LIBRARY}', 1)), ''), url) AS name, url FROM fi WHERE kind = 'script')
SELECT load_id, 'script' AS kind, name, count(*) AS copies FROM s GROUP BY load_id, name HAVING count(*) > 1 UNION ALL SELECT load_id, 'style', url, count(*) FROM fi WHERE kind = 'style' GROUP BY load_id, url HAVING count(*) > 1""")
def duplicate_parts(spark: SparkSession, sf: str) -> DataFrame:
    return lp.duplicate_parts(parts(spark, sf, FILES))


@query(f"WITH {_in('fi', FILES)} SELECT load_id, kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (blocking) AS blocking, count(*) FILTER (NOT contains(url, page_host)) AS outside FROM fi GROUP BY load_id, kind")
def code_totals(spark: SparkSession, sf: str) -> DataFrame:
    return lp.code_totals(parts(spark, sf, FILES))


_FONT = f"""{_in('fa', FACES)}, {_in('fo', FONTS)}, hv AS (SELECT load_id, sum(bytes) AS b FROM fo WHERE regexp_matches(url, '{lp.FONT}') GROUP BY load_id),
mw AS (SELECT load_id, count(*) AS n FROM (SELECT load_id, family FROM fa WHERE family IS NOT NULL GROUP BY load_id, family HAVING count(DISTINCT weight) >= {lp.MANY}) GROUP BY load_id),
fx AS (SELECT load_id, 'many weights' AS issue, 'low' AS severity, n AS affected FROM mw UNION ALL SELECT fa.load_id, 'invisible text', 'medium', count(*) FROM fa JOIN hv USING (load_id) WHERE display = 'block' AND b > {lp.HEAVY} GROUP BY fa.load_id
 UNION ALL SELECT load_id, 'no display', 'low', count(*) FROM fa WHERE coalesce(display, '') = '' GROUP BY load_id)"""
_IMAGE = f"""{_in('im', IMAGES)}, ix AS (SELECT load_id, src, 'lazy above the fold' AS issue, 'high' AS severity FROM im WHERE in_viewport AND loading = 'lazy' UNION ALL SELECT load_id, src, 'no dimensions', 'medium' FROM im WHERE NOT has_dimensions AND coalesce(natural_w, 0) + coalesce(rendered_w, 0) > 0
 UNION ALL SELECT load_id, src, 'larger than shown', 'high' FROM im WHERE natural_w > rendered_w * {lp.WIDER} AND bytes > {lp.OVERSIZE} UNION ALL SELECT load_id, src, 'old format', 'medium' FROM im WHERE regexp_matches(src, '{lp.LEGACY}') AND bytes > {lp.LARGE})"""


@query(f"WITH {_FONT} SELECT * FROM fx")
def font_issues(spark: SparkSession, sf: str) -> DataFrame:
    return lp.font_issues(parts(spark, sf, FACES), parts(spark, sf, FONTS))


@query(f"WITH {_IMAGE} SELECT * FROM ix")
def image_issues(spark: SparkSession, sf: str) -> DataFrame:
    return lp.image_issues(parts(spark, sf, IMAGES))


@query(f"""WITH {_FONT}, {_IMAGE}, al AS (SELECT load_id, issue, severity, sum(affected) AS affected FROM (SELECT * FROM fx UNION ALL SELECT load_id, issue, severity, 1 FROM ix) GROUP BY ALL)
SELECT load_id, CAST(row_number() OVER (PARTITION BY load_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, affected DESC, issue) AS INTEGER) AS rank, issue, severity, CAST(affected AS BIGINT) AS affected FROM al""")
def load_advice(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of a load's fonts and images by severity and by how much they touch."""
    images = lp.image_issues(parts(spark, sf, IMAGES)).select("load_id", "issue", "severity", F.lit(1).cast("long").alias("affected"))
    return lp.ranked_issues(lp.font_issues(parts(spark, sf, FACES), parts(spark, sf, FONTS)).unionByName(images))
