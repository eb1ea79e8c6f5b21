"""Rows of a report as a reader filters and orders them (W10, W11, N2), and files of sitemaps (K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in the order of a report.
ORDER = ("critical", "high", "medium", "low", "info", "manual", "passed")
#: Bytes above which a sitemap file comes near its limit.
NEAR_LIMIT = 45 * 1024 * 1024


def severity_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, k) for k, s in enumerate(ORDER)], F.lit(len(ORDER)))


def report_rows(findings: DataFrame, status: str | None = None, category: str | None = None, scope: str | None = None, search: str = "") -> DataFrame:
    """findings (status, category, page, name, evidence, confidence) with `rank`, those that pass: of a status
    (`manual` takes `info` too), a category, the whole site or single pages, with the words searched for
    somewhere in them; by severity, then the surest first, then by name and page."""
    rows = findings
    if status is not None:
        rows = rows.where(F.col("status").isin("manual", "info") if status == "manual" else F.col("status") == status)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if scope is not None:
        rows = rows.where((F.col("page") == "Site") == (scope == "site"))
    if search:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "name", "evidence", "page")), F.lit(search.lower())))
    own = ["site"] if "site" in findings.columns else []
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(severity_rank(F.col("status")), F.desc("confidence"), "name", "page")))


def user_ordered(pages: DataFrame) -> DataFrame:
    """pages (site, section, page_id, user_order, score) with `place` in each section: those that someone has
    put in order first, the others by falling score."""
    order = Window.partitionBy("site", "section").orderBy(F.asc_nulls_last("user_order"), F.desc(F.coalesce("score", F.lit(0))), "page_id")
    return pages.withColumn("place", F.row_number().over(order))


def js_heavy(words: Column, html_length: Column, scripts: Column, inline_scripts: Column) -> Column:
    """Whether a page shows little text but brings much markup and many scripts."""
    return (words < 40) & (html_length > 25_000) & ((scripts >= 8) | (inline_scripts >= 6))


def sitemap_index(files: DataFrame) -> DataFrame:
    """(site, name, body) of sites with several sitemap files (site, file_no, bytes): the index that names them."""
    entry = F.concat(F.lit("<sitemap><loc>https://"), "site", F.lit("/sitemap-"), (F.col("file_no") + 1).cast("string"), F.lit(".xml</loc></sitemap>"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_no", entry.alias("entry")))), lambda x: x["entry"]), "")
    rows = files.groupBy("site").agg(F.count("*").alias("n"), listed.alias("entries")).where("n > 1")
    return rows.select("site", F.lit("sitemap-index.xml").alias("name"), F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "entries", F.lit("</sitemapindex>")).alias("body"))


def near_limit(files: DataFrame, most: int = NEAR_LIMIT) -> DataFrame:
    """(site, file_no, bytes) of the files that come near the limit."""
    return files.where(F.col("bytes") > most).select("site", "file_no", "bytes")
