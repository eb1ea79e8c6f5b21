"""What a site's parts say of each other: links, sitemaps, canonicals, anchors, languages, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_status(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """links (site, source, target) to pages (page_id, status) that are gone or that lead elsewhere."""
    kind = F.when(F.col("status") >= 400, "broken").when(F.col("status").between(300, 399), "redirect")
    return links.join(fetched.select(F.col("page_id").alias("target"), "status"), "target").select("site", "source", "target", "status", kind.alias("kind")).where("kind is not null")


def sitemap_orphans(listed: DataFrame, links: DataFrame, crawled: DataFrame) -> DataFrame:
    """Listed pages that nothing links to and that no crawl has met."""
    return listed.join(links.select(F.col("target").alias("page_id")), "page_id", "left_anti").join(crawled.select("page_id"), "page_id", "left_anti")


def listed_trouble(listed: DataFrame, checks: DataFrame) -> DataFrame:
    """(site, page_id, trouble): listed pages whose check ended badly or on another address."""
    trouble = F.when(F.col("status").isin(404, 410), "broken_sitemap_url").when((F.col("status") == 200) & (F.col("hops") > 0), "redirecting_sitemap_url")
    return listed.join(checks.select("page_id", "status", "hops"), "page_id").select("site", "page_id", trouble.alias("trouble")).where("trouble is not null")


def canonical_decision(pages: DataFrame) -> DataFrame:
    """pages (url_site, url_key, canonical, canonical_site, canonical_key) with `decision`: self, external or other."""
    none = F.col("canonical").isNull() | (F.col("canonical") == "") | (F.col("canonical_key") == F.col("url_key"))
    return pages.withColumn("decision", F.when(none, "self").when(F.col("canonical_site") != F.col("url_site"), "external").otherwise("other"))


def canonical_targets(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """(page_id, issue) of canonical addresses that are gone or lead elsewhere; fetched (canonical_key, status)."""
    issue = F.when(F.col("status") == 404, "canonical_404").when(F.col("status").between(300, 399), "canonical_redirect")
    return pages.join(fetched, "canonical_key").select("page_id", issue.alias("issue")).where("issue is not null")


def missing_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links whose fragment none of the target's anchors (target, anchor) is: as it stands, in any case, or decoded."""
    asked = links.where("fragment <> ''")
    forms = anchors.select("target", F.explode(F.array(F.concat(F.lit("="), "anchor"), F.concat(F.lit("~"), F.lower("anchor")))).alias("form")).distinct()
    wants = F.array(F.concat(F.lit("="), "fragment"), F.concat(F.lit("~"), F.lower("fragment")), F.concat(F.lit("="), F.coalesce(F.try_url_decode("fragment"), F.col("fragment"))))
    found = asked.select("source", "target", "fragment", F.explode(wants).alias("form")).join(forms, ["target", "form"], "left_semi").select("source", "target", "fragment").distinct()
    return asked.join(found, ["source", "target", "fragment"], "left_anti")


def language_links(alternates: DataFrame) -> DataFrame:
    """(page_id, alternates, invalid, has_default, has_self) of alternates (page_id, url_key, lang, href_key)."""
    valid = F.col("lang").rlike("^([a-z]{2,3}(-[A-Za-z0-9]+)?|x-default)$")
    return alternates.groupBy("page_id").agg(F.count("*").alias("alternates"), F.count_if(~valid).alias("invalid"), F.bool_or(F.col("lang") == "x-default").alias("has_default"), F.bool_or(F.col("href_key") == F.col("url_key")).alias("has_self"))


def rule_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, agent, type, path, change): rules that one version of a robots file has and the other lacks."""
    keys = ["site", "agent", "type", "path"]
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def run_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(site, category, previous, current, change) of two runs' scores; a category that one lacks counts 0 there."""
    both = before.select("site", "category", F.col("score").alias("p")).join(now.select("site", "category", F.col("score").alias("c")), ["site", "category"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("site", "category", zero("p").alias("previous"), zero("c").alias("current"), (zero("c") - zero("p")).alias("change"))


def bare_address(url: Column) -> Column:
    return F.regexp_replace(url, "^[a-z]+:", "")


def enriched(resources: DataFrame, metadata: DataFrame) -> DataFrame:
    """resources (load_id, url, ...) with status, content type and bytes of metadata, whatever the scheme."""
    meta = metadata.groupBy("load_id", bare_address(F.col("url")).alias("bare")).agg(F.min("status").alias("status"), F.min("content_type").alias("content_type"), F.max("bytes").alias("bytes"))
    return resources.withColumn("bare", bare_address(F.col("url"))).join(meta, ["load_id", "bare"], "left").drop("bare")


def unused_preloads(hints: DataFrame, resources: DataFrame) -> DataFrame:
    """hints (load_id, url) that no resource of the load answers."""
    return hints.join(resources.select("load_id", "url"), ["load_id", "url"], "left_anti")


def dated(pages: DataFrame, lastmods: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """(page_id, date, source, reliable): the first of the columns `sources` that is a date from 1990 to
    2100, else the sitemap's; that and a visible date are not reliable."""
    day = lambda c: F.try_to_timestamp(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    fit = lambda c: F.when(F.year(day(c)).between(1990, 2100), day(c))
    rows = pages.join(lastmods.select("page_id", "lastmod"), "page_id", "left")
    picks = [F.when(fit(F.col(c)).isNotNull(), F.struct(fit(F.col(c)).alias("date"), F.lit(c).alias("source"))) for c in (*sources, "lastmod")]
    return rows.select("page_id", F.coalesce(*picks).alias("x")).select("page_id", "x.date", "x.source", F.when(F.col("x.source").isNotNull(), ~F.col("x.source").isin("visible", "lastmod")).alias("reliable"))


def united(*producers: DataFrame) -> DataFrame:
    """All producers' findings in one long table; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), producers)
