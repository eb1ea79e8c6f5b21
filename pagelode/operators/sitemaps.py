"""Sitemap files as they come, and what their indexes lead to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import urls
from pagelode.operators.lineage import stored

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def _inner(block: Column, tag: str) -> Column:
    """The text of the first `tag` of a block, of any prefix, in CDATA or not; null if it is empty."""
    found = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?{tag}\s*>", 1)
    return F.nullif(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, found), F.lit(""))


def entries(files: DataFrame) -> DataFrame:
    """(url, is_index, pos, loc, lastmod) of sitemap files (url, body). Images, videos and news inside an
    entry are no entries; a body that is no sitemap has none."""
    own = F.regexp_replace("body", r"(?is)<(image|video|news):(\w+)\b[^>]*>.*?</\1:\2\s*>", " ")
    root = F.lower(F.regexp_extract("body", r"(?is)<(?:\w+:)?(sitemapindex|urlset)\b", 1))
    block = lambda tag: F.regexp_extract_all(own, F.lit(rf"(?is)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>"), F.lit(1))
    blocks = F.when(root == "sitemapindex", block("sitemap")).when(root == "urlset", block("url"))
    rows = files.select("url", (root == "sitemapindex").alias("is_index"), F.posexplode(blocks).alias("pos", "block"))
    return rows.select("url", "is_index", "pos", _inner(F.col("block"), "loc").alias("loc"), _inner(F.col("block"), "lastmod").alias("lastmod")).where("loc is not null")


def expanded(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(site, sitemap, level, is_index, entries): all files that a site's roots (site, url) lead to, at the
    level where they come first. A file is read once, so that cycles end; an unknown file has null
    `is_index` and no entries."""
    listed = stored(entries(files))
    known = stored(files.select("url", F.rlike("body", F.lit(r"(?i)<(\w+:)?sitemapindex\b")).alias("is_index")).groupBy("url").agg(F.bool_or("is_index").alias("is_index")))
    children = listed.where("is_index").select(F.col("url").alias("sitemap"), F.col("loc").alias("child")).distinct()
    frontier = stored(roots.select("site", F.col("url").alias("sitemap")).distinct())
    levels: list[DataFrame] = []
    while not frontier.isEmpty():
        levels.append(frontier.withColumn("level", F.lit(len(levels))))
        seen = reduce(DataFrame.unionByName, levels).select("site", "sitemap")
        step = frontier.join(children, "sitemap").select("site", F.col("child").alias("sitemap")).distinct()
        frontier = stored(step.join(seen, ["site", "sitemap"], "left_anti"))
    if not levels:
        levels = [frontier.withColumn("level", F.lit(0))]
    counts = listed.groupBy(F.col("url").alias("sitemap")).agg(F.count("*").alias("entries"))
    rows = reduce(DataFrame.unionByName, levels).join(known.withColumnRenamed("url", "sitemap"), "sitemap", "left").join(counts, "sitemap", "left")
    return rows.select("site", "sitemap", "level", "is_index", F.coalesce("entries", F.lit(0)).alias("entries"))


def listed_pages(files: DataFrame, found: DataFrame) -> DataFrame:
    """(site, key, loc, lastmod, sitemaps): the pages that the found files list, once by canonical key, with
    the latest date and the number of files that list each."""
    rows = entries(files).where("not is_index").join(found.select("site", F.col("sitemap").alias("url")), "url")
    keyed = rows.withColumn("key", urls.canonical_key(F.col("loc")))
    return keyed.groupBy("site", "key").agg(F.min("loc").alias("loc"), F.max("lastmod").alias("lastmod"), F.count_distinct("url").alias("sitemaps"))


def lastmod_issues(listed: DataFrame, as_of: Column) -> DataFrame:
    """(site, missing, unreadable, future, pages): dates of the listed pages; as_of is a date."""
    date = F.try_to_date(F.substring("lastmod", 1, 10))
    return listed.groupBy("site").agg(
        F.count_if(F.col("lastmod").isNull()).alias("missing"), F.count_if(F.col("lastmod").isNotNull() & date.isNull()).alias("unreadable"),
        F.count_if(F.coalesce(date > as_of, F.lit(False))).alias("future"), F.count("*").alias("pages"),
    )
