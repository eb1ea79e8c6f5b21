"""What page loads are made of: coverage of answers, scripts, styles, fonts, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Content types and addresses of text, bytes above which text should be compressed.
TEXT_TYPE, TEXT_URL, WORTH = "html|css|javascript|json|xml|svg|text/", r"(?i)\.(css|js|mjs|html?|json|xml|svg|txt)([?#]|$)", 10 * 1024
#: A script's name without version and `min`; font files; image formats of old.
LIBRARY, FONT, LEGACY = r"([^/?#]+?)(?:[-_.]v?\d+(?:\.\d+)*(?:[-_.]min)?)?\.js([?#]|$)", r"(?i)\.(woff2?|ttf|otf|eot)([?#]|$)", r"(?i)\.(jpe?g|png|gif|bmp)([?#]|$)"
#: How much wider than it shows an image may be, bytes of one that is too large, of a large one of
#: an old format, of heavy fonts; weights of a family that are many.
WIDER, OVERSIZE, LARGE, HEAVY, MANY = 1.6, 100 * 1024, 200 * 1024, 150 * 1024, 4


def answer_coverage(answers: DataFrame) -> DataFrame:
    """(load_id, answers, ok, redirected, failed, text, compressed, worth_it, protocols) of answers (load_id, url,
    status, content_type, encoding, bytes, protocol): worth_it counts the text over 10 KB, or of unknown
    size, that came uncompressed."""
    is_text = F.lower(F.coalesce("content_type", F.lit(""))).rlike(TEXT_TYPE) | F.coalesce(F.col("url"), F.lit("")).rlike(TEXT_URL)
    packed = ~F.lower(F.coalesce("encoding", F.lit(""))).isin("", "identity")
    heavy = F.col("bytes").isNull() | (F.col("bytes") > WORTH)
    return answers.groupBy("load_id").agg(
        F.count("*").alias("answers"), F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("status").between(300, 399)).alias("redirected"), F.count_if(F.col("status") >= 400).alias("failed"),
        F.count_if(is_text).alias("text"), F.count_if(is_text & packed).alias("compressed"), F.count_if(is_text & ~packed & heavy).alias("worth_it"), F.array_join(F.sort_array(F.collect_set("protocol")), ",").alias("protocols"),
    )


def library(url: Column) -> Column:
    """A script's library: its file name without version, in lower case, else the address itself."""
    name = F.lower(F.regexp_extract(url, f"(?i){LIBRARY}", 1))
    return F.when(name != "", name).otherwise(url)


def duplicate_parts(files: DataFrame) -> DataFrame:
    """(load_id, kind, name, copies) of files (load_id, kind, url): libraries that scripts of different
    addresses bring, and stylesheets whose address comes more than once."""
    scripts = files.where("kind = 'script'").select("load_id", library(F.col("url")).alias("name"), "url").distinct()
    twice = scripts.groupBy("load_id", "name").agg(F.count("*").alias("copies")).withColumn("kind", F.lit("script"))
    styles = files.where("kind = 'style'").groupBy("load_id", F.col("url").alias("name")).agg(F.count("*").alias("copies")).withColumn("kind", F.lit("style"))
    return twice.unionByName(styles).where("copies > 1").select("load_id", "kind", "name", "copies")


def code_totals(files: DataFrame) -> DataFrame:
    """(load_id, kind, files, bytes, blocking, outside): of scripts and styles; bytes are null where none are
    known, outside counts those that don't hold the page's host."""
    outside = ~F.contains("url", F.col("page_host"))
    return files.groupBy("load_id", "kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if("blocking").alias("blocking"), F.count_if(outside).alias("outside"))


def font_issues(faces: DataFrame, resources: DataFrame) -> DataFrame:
    """(load_id, issue, severity, affected): of faces (load_id, family, weight, display) and resources (load_id, url, bytes)."""
    heavy = resources.where(F.col("url").rlike(FONT)).groupBy("load_id").agg(F.sum("bytes").alias("font_bytes"))
    families = faces.where("family is not null").groupBy("load_id", "family").agg(F.count_distinct("weight").alias("weights"))
    many = families.where(F.col("weights") >= MANY).groupBy("load_id").agg(F.count("*").alias("affected")).select("load_id", F.lit("many weights").alias("issue"), F.lit("low").alias("severity"), "affected")
    shown = faces.groupBy("load_id").agg(F.count_if(F.col("display") == "block").alias("block"), F.count_if(F.coalesce("display", F.lit("")) == "").alias("open"))
    hidden = shown.join(heavy, "load_id").where((F.col("block") > 0) & (F.col("font_bytes") > HEAVY)).select("load_id", F.lit("invisible text").alias("issue"), F.lit("medium").alias("severity"), F.col("block").alias("affected"))
    unset = shown.where("open > 0").select("load_id", F.lit("no display").alias("issue"), F.lit("low").alias("severity"), F.col("open").alias("affected"))
    return many.union(hidden).union(unset)


def image_issues(images: DataFrame) -> DataFrame:
    """(load_id, src, issue, severity) of images (load_id, src, bytes, natural_w, rendered_w, loading,
    in_viewport, has_dimensions)."""
    seen = F.coalesce(F.col("natural_w"), F.lit(0)) + F.coalesce(F.col("rendered_w"), F.lit(0)) > 0
    issue = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        issue(F.col("in_viewport") & (F.col("loading") == "lazy"), "lazy above the fold", "high"), issue(~F.coalesce("has_dimensions", F.lit(False)) & seen, "no dimensions", "medium"),
        issue((F.col("natural_w") > F.col("rendered_w") * WIDER) & (F.col("rendered_w") > 0) & (F.col("bytes") > OVERSIZE), "larger than shown", "high"), issue(F.col("src").rlike(LEGACY) & (F.col("bytes") > LARGE), "old format", "medium"),
    ))
    return images.select("load_id", "src", F.explode(found).alias("x")).select("load_id", "src", "x.issue", "x.severity")


def ranked_issues(findings: DataFrame) -> DataFrame:
    """(load_id, rank, issue, severity, affected): the issues of each load by severity, then by how much they
    affect, then by name (C33)."""
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    grouped = findings.groupBy("load_id", "issue", "severity").agg(F.sum("affected").alias("affected"))
    rank = F.row_number().over(Window.partitionBy("load_id").orderBy(order, F.desc("affected"), "issue"))
    return grouped.select("load_id", rank.alias("rank"), "issue", "severity", "affected")
