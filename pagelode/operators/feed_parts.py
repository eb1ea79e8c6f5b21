"""Feeds as they come, where pages name them, and what a page gives an item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.functions import urls

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
#: Boilerplate in descriptions.
BOILERPLATE = (r"(?i)cookie(s)? (preferences|notice|banner|policy)[^\n.;]{0,80}", r"(?i)by continuing (to|using|to use)[^\n.;]{0,80}", r"(?i)we (use|use cookies)[^\n.;]{0,100}", r"(?i)(\ball rights reserved|©|\bcopyright)[^\n.;]{0,60}")
#: Breadcrumb names that are no category, and the longest name of one.
NO_CATEGORY, LONGEST = r"(?i)^(home|homepage|blog|news|category|categories|tag|tags|search)\.?$", 40
#: Types of audio by ending.
AUDIO = (("mp3", "audio/mpeg"), ("m4a", "audio/mp4"), ("aac", "audio/aac"), ("ogg", "audio/ogg"), ("oga", "audio/ogg"), ("wav", "audio/wav"))


def _decoded(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, text)


def _raw(block: Column, tag: str) -> Column:
    return F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def _value(raw: Column) -> Column:
    """Text of an element: CDATA as it stands, else entities decoded; null if nothing is left."""
    inner = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.nullif(F.trim(F.when(inner != "", inner).otherwise(_decoded(raw))), F.lit(""))


def _text(block: Column, tag: str) -> Column:
    return _value(_raw(block, tag))


def _attributes(tag: Column, name: str) -> Column:
    return F.nullif(_decoded(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def _tags(block: Column, tag: str) -> Column:
    return F.regexp_extract_all(block, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))


def _first(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source, format, pos, title, link, guid, description, published, author, categories, image) of feed
    files (source, body), RSS or Atom: guid falls back to the link, the image comes from media content,
    then thumbnails, then an enclosed image. A body that is neither has no items."""
    rss = F.col("body").rlike(r"(?i)<rss\b")
    atom = ~rss & F.col("body").rlike(r"(?i)<feed\b") & ~F.col("body").rlike(r"""(?is)<feed\b[^>]*\sxmlns=["'](?![^"']*atom["'])[^"']*["']""")
    kind = F.when(rss & F.col("body").rlike(r"""(?i)<rss\b[^>]*version=["'][^"']*2\.0"""), "rss2").when(rss, "rss").when(atom, "atom")
    blocks = lambda tag: F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    b = F.col("block")
    rows = feeds.select("source", kind.alias("format"), F.posexplode(F.when(kind == "atom", blocks("entry")).when(kind.isNotNull(), blocks("item"))).alias("pos", "block"))
    is_atom = F.col("format") == "atom"
    links = _tags(b, "link")
    rel = lambda t: F.lower(F.coalesce(_attributes(t, "rel"), F.lit("")))
    href = lambda want: _first(F.transform(F.filter(links, lambda t: rel(t).isin(*want)), lambda t: _attributes(t, "href")))
    each = lambda tag: F.array_compact(F.transform(F.regexp_extract_all(b, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), _value))
    terms = F.array_compact(F.transform(_tags(b, "category"), lambda t: _attributes(t, "term")))
    media = lambda tag: _first(F.transform(_tags(b, tag), lambda t: _attributes(t, "url")))
    enclosed = _first(F.transform(F.filter(_tags(b, "enclosure"), lambda t: F.coalesce(_attributes(t, "type"), F.lit("")).rlike("(?i)^image/")), lambda t: _attributes(t, "url")))
    link = F.when(is_atom, href(("", "alternate"))).otherwise(_text(b, "link"))
    guid = F.when(is_atom, _text(b, "id")).otherwise(_text(b, "guid"))
    return rows.select(
        "source", "format", "pos", _text(b, "title").alias("title"), link.alias("link"), F.coalesce(guid, link).alias("guid"),
        F.when(is_atom, F.coalesce(_text(b, "summary"), _text(b, "content"))).otherwise(_text(b, "description")).alias("description"),
        F.when(is_atom, F.coalesce(_text(b, "published"), _text(b, "updated"))).otherwise(_text(b, "pubDate")).alias("published"),
        F.when(is_atom, _text(b, "name")).otherwise(F.coalesce(_text(b, "dc:creator"), _text(b, "author"))).alias("author"),
        F.when(is_atom, F.when(F.size(terms) > 0, terms).otherwise(each("category"))).otherwise(each("category")).alias("categories"),
        F.when(is_atom, href(("enclosure",))).otherwise(F.coalesce(media("media:content"), media("media:thumbnail"), enclosed)).alias("image"),
    )


def feed_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, feed, type, title): the feeds that a page's head names, as full addresses."""
    tag = F.col("tag")
    rows = pages.select("page_id", "url", F.posexplode(_tags(F.col("html"), "link")).alias("pos", "tag"))
    named = rows.where(F.coalesce(_attributes(tag, "rel"), F.lit("")).rlike("(?i)alternate") & F.coalesce(_attributes(tag, "type"), F.lit("")).rlike("(?i)rss|atom|xml") & _attributes(tag, "href").isNotNull())
    return named.select("page_id", "pos", urls.resolve(_attributes(tag, "href"), F.col("url")).alias("feed"), _attributes(tag, "type").alias("type"), F.coalesce(_attributes(tag, "title"), F.lit("")).alias("title"))


def picked_title(headline: Column, og: Column, title: Column, h1: Column, site_name: Column) -> Column:
    """The first of headline, og:title, title and heading, without the site's name at its end."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (headline, og, title, h1)], F.lit(""))
    name = F.trim(F.coalesce(site_name, F.lit("")))
    ends = F.endswith(F.lower(first), F.lower(name)) & (name != "")
    cut = F.substring(first, F.lit(1), F.length(first) - F.length(name))
    bare = F.regexp_replace(cut, r"\s*[|•>–—-]\s*$", "")
    return F.trim(F.regexp_replace(F.when(ends & (bare != cut), bare).otherwise(first), r"\s+", " "))


def picked_description(meta: Column, og: Column, paragraph: Column, longest: int = 300) -> Column:
    """The first of meta description, og:description and first paragraph, without markup and boilerplate,
    cut between words where it is too long."""
    raw = F.coalesce(*[F.nullif(c, F.lit("")) for c in (meta, og, paragraph)], F.lit(""))
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), (r"(?s)<!\[CDATA\[.*?\]\]>", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", "<[^>]+>", *BOILERPLATE, r"[\x00-\x1f\x7f]+"), raw)
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^[\s.,;:!]+", ""))
    head = F.substring(s, 1, longest)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > longest * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(s) > longest, F.concat(F.regexp_replace(cut, "[,.:;!?]+$", ""), F.lit("…"))).otherwise(s)


def item_categories(section: Column, crumbs: Column) -> Column:
    """At most two: the article's section, and the breadcrumb before the last unless its name says nothing."""
    names = F.filter(F.transform(F.coalesce(crumbs, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    above = F.when(F.size(names) >= 2, F.element_at(names, -2))
    usable = F.when(~above.rlike(NO_CATEGORY) & (F.length(above) <= LONGEST), above)
    return F.array_distinct(F.array_compact(F.array(F.nullif(section, F.lit("")), usable)))


def audio_type(url: Column) -> Column:
    ending = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ending == e, t) for e, t in AUDIO])


def feed_validation(items: DataFrame) -> DataFrame:
    """(source, items, no_title, no_link, relative, repeated_guid, undated): checks of a feed's items before or
    after it is written (C35); dates are those that a feed's format allows."""
    undated = F.col("published").isNull() | (F.try_to_timestamp("published").isNull() & ~F.col("published").rlike(r"^(?:[A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}(:\d{2})? (?:[A-Z]{1,5}|[+-]\d{4})$"))
    counts = items.groupBy("source", "guid").agg(F.count("*").alias("n"), F.count_if(F.col("title").isNull()).alias("t"), F.count_if(F.col("link").isNull()).alias("l"), F.count_if(~F.col("link").rlike("(?i)^https?://")).alias("r"), F.count_if(undated).alias("u"))
    repeated = F.when(F.col("guid").isNotNull(), F.col("n") - 1).otherwise(0)
    return counts.groupBy("source").agg(F.sum("n").alias("items"), F.sum("t").alias("no_title"), F.sum("l").alias("no_link"), F.sum("r").alias("relative"), F.sum(repeated).alias("repeated_guid"), F.sum("u").alias("undated"))
