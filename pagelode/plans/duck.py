"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from pagelode.functions import text as tx
from pagelode.functions import urls

_U = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\\?([^#]*))?"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{_U}', {n})"


def host(url: str) -> str:
    return f"lower({part(url, 2)})"


def site(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def strip(html: str, tags: tuple[str, ...]) -> str:
    for t in tags:
        html = f"regexp_replace({html}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    return html


def plain(html: str) -> str:
    x = f"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in tx._ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a.replace("'", "''"), b.replace("'", "''"))
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def comments(html: str) -> str:
    return f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"


def visible(html: str) -> str:
    return plain(strip(comments(html), tx.HIDDEN))


def main_text(html: str) -> str:
    inner = strip(strip(comments(html), tx.HIDDEN), tx.FRAME)
    return plain(f"regexp_extract({inner}, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1)")


def words(text: str) -> str:
    return f"[w for w in regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}'']+') if regexp_matches(w, '[\\p{{L}}\\p{{N}}]')]"


def half_up(x: str, digits: int = 0) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def kept_query(query: str) -> str:
    kept = f"[p for p in string_split({query}, '&') if p <> '' and not (lower(string_split(p, '=')[1]) in ({names(urls.TRACKING)}))]"
    return f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


PAGE = f"""h AS (SELECT page_id, url, html, lower({part('url', 1)}) AS scheme, {host('url')} AS host, {site('url')} AS site, {part('url', 4)} AS path, {part('url', 5)} AS query FROM pages)"""
MAIN = f"""{PAGE},
f AS (SELECT page_id, url, site, path, scheme, html, {plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {main_text('html')} AS main FROM h)"""
TOKENS = f"""{MAIN},
ws AS (SELECT page_id, site, {words('lower(main)')} AS w FROM f),
tok AS (SELECT page_id, site, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM ws)"""
EDGES = f"""{PAGE},
o AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM h),
e AS (SELECT a.site, a.page_id AS src, b.page_id AS dst FROM o AS a JOIN o AS b ON a.site = b.site AND (b.n = 2 * a.n OR b.n = 3 * a.n + 1 OR (a.n % 5 = 0 AND b.n = a.n - 1)))"""
