"""URL and host columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid",
    "mc_cid", "mc_eid", "ref", "ref_src", "_ga", "_gl", "spm", "yclid", "wickedid", "igshid", "si",
)
ASSETS = r"(?i)\.(css|js|mjs|json|xml|png|jpe?g|webp|avif|gif|svg|ico|woff2?|ttf|eot|otf|mp4|webm|mov|avi|mp3|wav|zip|rar|7z|gz|tar|exe|dmg|apk)$"
BINARIES = r"(?i)\.(zip|rar|7z|gz|tar|exe|dmg|apk|mp4|webm|mov|avi|mp3|wav)$"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def port(url: Column) -> Column:
    """The port unless it is the scheme's own; else empty."""
    own = F.regexp_extract(url, _URL, 3)
    return F.when(((scheme(url) == "https") & (own == "443")) | ((scheme(url) == "http") & (own == "80")), "").otherwise(own)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 5)


def site(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def pairs(url: Column) -> Column:
    """Query pairs in order."""
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def is_tracking(pair: Column) -> Column:
    return F.lower(F.split(pair, "=")[0]).isin(*TRACKING)


def kept_query(url: Column) -> Column:
    """Query without tracking parameters and repeated pairs; with its question mark, or empty."""
    kept = F.array_distinct(F.filter(pairs(url), lambda p: ~is_tracking(p)))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def has_tracking(url: Column) -> Column:
    return F.exists(pairs(url), is_tracking)


def _origin(url: Column, named: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), named, F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""))


def without_dots(path_: Column) -> Column:
    """A path with its `.` and `..` parts carried out; climbing stops at the root."""
    parts = F.split(path_, "/")
    keep = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(parts, F.array().cast("array<string>"), keep)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path_.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(ended, "/")).otherwise(path_)


def normalize(url: Column) -> Column:
    """Absolute http(s) form without fragment, default port, doubled slashes, dots and tracking; else null."""
    trimmed = F.regexp_replace(F.regexp_replace(without_dots(path(url)), "/+", "/"), "(.)/$", "$1")
    folded = F.when(trimmed == "", "/").otherwise(trimmed)
    return F.when(scheme(url).isin("http", "https") & (host(url) != ""), F.concat(_origin(url, host(url)), folded, kept_query(url)))


def canonical_key(url: Column) -> Column:
    """One string for one resource: as normalize(), without www. and trailing slashes."""
    return F.concat(_origin(url, site(url)), F.regexp_replace(path(url), "/+$", ""), kept_query(url))


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")


def is_internal(url: Column, root: Column, subdomains: bool = False) -> Column:
    """Whether url is on root's site, or under it if subdomains count."""
    same = site(url) == site(root)
    return (same | F.endswith(site(url), F.concat(F.lit("."), site(root)))) if subdomains else same


def resolve(href: Column, base: Column) -> Column:
    """href against an absolute base."""
    at_root = F.concat(scheme(base), F.lit("://"), host(base), F.when(port(base) != "", F.concat(F.lit(":"), port(base))).otherwise(""))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(at_root, href))
        .when(href.startswith("?"), F.concat(at_root, path(base), href))
        .otherwise(F.concat(at_root, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(href, "^[^?#]*", 0))), F.regexp_replace(href, "^[^?#]*", "")))
    )


def mixed_content(html: Column, url: Column) -> Column:
    """http:// sources and links of an https page."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)(?:src|href)=["'](http://[^"']+)"""), F.lit(1))
    return F.when(scheme(url) == "https", found).otherwise(F.array().cast("array<string>"))
