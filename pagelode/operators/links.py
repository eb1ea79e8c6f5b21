"""Links, link graph."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions import text as tx
from pagelode.functions import urls
from pagelode.operators.lineage import shared_folder, stored

_ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, site, pos, href, target, key, text, internal, nav): a row for each anchor of a page,
    script and mail links left out."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("text"))
    frame = F.regexp_extract("html", r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    rows = pages.select("page_id", "url", frame.alias("frame"), F.posexplode(found).alias("pos", "a")).where(~F.col("a.href").rlike(r"(?i)^(javascript|mailto|tel|data):"))
    target = urls.resolve(F.col("a.href"), F.col("url"))
    out = rows.select("page_id", urls.site(F.col("url")).alias("site"), "pos", F.col("a.href").alias("href"), target.alias("target"), "url", tx.plain(F.col("a.text")).alias("text"), F.contains(F.col("frame"), F.concat(F.lit('"'), F.col("a.href"), F.lit('"'))).alias("nav"))
    return out.select("page_id", "site", "pos", "href", "target", urls.canonical_key(F.col("target")).alias("key"), "text", urls.is_internal(F.col("target"), F.col("url")).alias("internal"), "nav")


def deduplicated(links: DataFrame) -> DataFrame:
    """Per destination: how often, from how many pages, by which texts, where first."""
    return links.groupBy("site", "key").agg(
        F.count("*").alias("occurrences"), F.count_distinct("page_id").alias("sources"), F.array_join(F.array_sort(F.collect_set("text")), "|").alias("texts"),
        F.min("page_id").alias("first_page"), F.bool_or("nav").alias("nav_linked"),
    )


def unresolved(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links to no page of the corpus."""
    known = pages.select(urls.canonical_key(F.col("url")).alias("key")).distinct()
    return links.where("internal").join(known, "key", "left_anti")


def degrees(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, page_id, in_links, out_links) over distinct edges (src, dst) between pages."""
    once = edges.where("src <> dst").select("src", "dst").distinct()
    into = once.groupBy(F.col("dst").alias("page_id")).agg(F.count("*").alias("i"))
    out = once.groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("o"))
    rows = pages.select("site", "page_id").join(into, "page_id", "left").join(out, "page_id", "left")
    return rows.select("site", "page_id", F.coalesce("i", F.lit(0)).alias("in_links"), F.coalesce("o", F.lit(0)).alias("out_links"))


def click_depth(edges: DataFrame, homes: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, depth): clicks from the home pages, breadth first; pages that none reaches, or none within
    `most` clicks, are absent. Each level is written once, beside those before it."""
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/{uuid.uuid4().hex}"
    once = stored(edges.select("src", "dst").distinct())
    frontier = homes.select("page_id")
    for depth in itertools.count():
        frontier.select("page_id", F.lit(depth).alias("depth")).write.parquet(f"{folder}/level={depth}")
        read = spark.read.schema(T.StructType([T.StructField("page_id", edges.schema["dst"].dataType), T.StructField("depth", T.IntegerType())]))
        level, reached = read.parquet(f"{folder}/level={depth}"), read.parquet(folder)
        if depth == most or level.isEmpty():
            return reached.select("page_id", "depth")
        step = level.join(once, F.col("page_id") == F.col("src")).select(F.col("dst").alias("page_id")).distinct()
        frontier = step.join(reached.select("page_id"), "page_id", "left_anti")


def position_issues(degree: DataFrame, depth: DataFrame, deep: int = 4) -> DataFrame:
    """(site, page_id, issue): orphans, pages with one way in, dead ends and deep pages."""
    rows = degree.join(depth, "page_id", "left")
    issues = F.array_compact(
        F.array(
            F.when((F.col("in_links") == 0) & ~F.coalesce(F.col("depth") == 0, F.lit(False)), "orphan"), F.when((F.col("in_links") == 1) & (F.col("depth") > 0), "single_path"),
            F.when(F.col("out_links") == 0, "dead_end"), F.when(F.col("depth") > deep, "deep"),
        )
    )
    return rows.select("site", "page_id", F.explode(issues).alias("issue"))


def architecture(degree: DataFrame, depth: DataFrame) -> DataFrame:
    """Per site: pages, reached pages, mean and greatest depth, pages below depth three."""
    rows = degree.join(depth, "page_id", "left")
    return rows.groupBy("site").agg(F.count("*").alias("pages"), F.count("depth").alias("reached"), tx.half_up(F.avg("depth"), 2).alias("mean_depth"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > 3).alias("deep"))


def anchor_quality(links: DataFrame) -> DataFrame:
    """Per page: links, empty anchors, most uses of one anchor text."""
    uses = links.groupBy("page_id", "text").agg(F.count("*").alias("n"))
    return uses.groupBy("page_id").agg(F.sum("n").alias("links"), F.coalesce(F.sum(F.when(F.col("text") == "", F.col("n"))), F.lit(0)).alias("empty"), F.max(F.when(F.col("text") != "", F.col("n"))).alias("most_used"))
