"""Artefacts and their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators.lineage import shared_folder


def xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sitemap_files(urls: DataFrame, per_file: int = 50_000) -> DataFrame:
    """(site, file_no, urls, bytes, body): urlset files of per_file URLs at most, in the order of `ord`."""
    number = F.floor((F.row_number().over(Window.partitionBy("site").orderBy("ord")) - 1) / per_file)
    rows = urls.withColumn("file_no", number).withColumn("entry", F.concat(F.lit("<url><loc>"), xml(F.col("loc")), F.lit("</loc></url>")))
    listed = F.array_sort(F.collect_list(F.struct("ord", "entry")))
    files = rows.groupBy("site", "file_no").agg(F.count("*").alias("urls"), F.array_join(F.transform(listed, lambda x: x["entry"]), "").alias("entries"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "entries", F.lit("</urlset>"))
    return files.select("site", "file_no", "urls", F.octet_length(body).cast("long").alias("bytes"), body.alias("body"))


def read_sitemaps(files: DataFrame) -> DataFrame:
    """(site, file_no, pos, loc): what sitemap files list."""
    found = F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    plain = F.col("loc")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return files.select("site", "file_no", F.posexplode(found).alias("pos", "loc")).select("site", "file_no", "pos", plain.alias("loc"))


def unique_items(items: DataFrame) -> DataFrame:
    """items with `reason`: null for those that stay; first by key, then, among the survivors, by title
    and folder."""
    by_key = F.row_number().over(Window.partitionBy("site", "key").orderBy("ord"))
    rows = items.withColumn("k", by_key)
    by_title = F.row_number().over(Window.partitionBy("site", F.lower(F.trim("title")), "folder", F.col("k") == 1).orderBy("ord"))
    reason = F.when(F.col("k") > 1, "Same URL").when((by_title > 1) & (F.trim("title") != ""), "Same title")
    return rows.withColumn("reason", reason).drop("k")


def newest(items: DataFrame, n: int) -> DataFrame:
    """The n newest items of each site, undated ones last."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc_nulls_last("published"), "ord"))
    return items.withColumn("rank", rank).where(F.col("rank") <= n)


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def feeds(items: DataFrame) -> DataFrame:
    """(site, items, body): an RSS channel of each site's items by rank."""
    entry = F.concat(F.lit("<item><title>"), xml(F.col("title")), F.lit("</title><link>"), xml(F.col("loc")), F.lit("</link><pubDate>"), rfc822(F.col("published")), F.lit("</pubDate></item>"))
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    rows = items.groupBy("site").agg(F.count("*").alias("items"), F.array_join(F.transform(listed, lambda x: x["entry"]), "").alias("entries"))
    return rows.select("site", "items", F.concat(F.lit('<rss version="2.0"><channel><title>'), "site", F.lit("</title>"), "entries", F.lit("</channel></rss>")).alias("body"))


def atom_feeds(items: DataFrame) -> DataFrame:
    """(site, items, body): an Atom feed of each site's dated items by rank, as old as its newest item."""
    at = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    link = lambda href: F.concat(F.lit('<link rel="alternate" href="'), href, F.lit('"/><id>'), href, F.lit("</id>"))
    entry = F.concat(F.lit("<entry><title>"), xml(F.col("title")), F.lit("</title>"), link(xml(F.col("loc"))), F.lit("<updated>"), at, F.lit("</updated><published>"), at, F.lit("</published></entry>"))
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    rows = items.groupBy("site").agg(F.count("*").alias("items"), F.max(at).alias("at"), F.array_join(F.transform(listed, lambda x: x["entry"]), "").alias("entries"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'), "site", F.lit("</title>"), link(F.concat(F.lit("https://"), "site", F.lit("/"))), F.lit("<updated>"), "at", F.lit("</updated>"))
    return rows.select("site", "items", F.concat(head, "entries", F.lit("</feed>")).alias("body"))


def exported(rows: DataFrame, kind: str, folder: str | None = None) -> DataFrame:
    """rows as `csv` or `json` files of a new folder, by default in the shared one, and what they give when read."""
    options = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if kind == "csv" else {}
    folder = folder or f"{shared_folder(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(folder)
    return rows.sparkSession.read.format(kind).schema(rows.schema).options(**options).load(folder)


def read_feeds(files: DataFrame) -> DataFrame:
    """(site, pos, title, link, published): items of RSS bodies."""
    item = F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))
    part = lambda tag: F.regexp_extract("item", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    rows = files.select("site", F.posexplode(item).alias("pos", "item"))
    return rows.select("site", "pos", part("title").alias("title"), part("link").alias("link"), F.try_to_timestamp(F.regexp_replace(part("pubDate"), "^[A-Za-z]+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")).alias("published"))


def compare_feeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """(site, key, change): items only in one feed, or in both with another title."""
    both = old.select("site", "key", F.col("title").alias("was"), F.lit(1).alias("o")).join(new.select("site", "key", F.col("title").alias("now"), F.lit(1).alias("n")), ["site", "key"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "title changed").otherwise("same")
    return both.select("site", "key", change.alias("change"))


def overridden(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(page_id, title): the edited title where an edit gives one."""
    return pages.select("page_id", "title").join(edits.select("page_id", F.col("title").alias("edited")), "page_id", "left").select("page_id", F.coalesce("edited", "title").alias("title"))


def llms_texts(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, body): a heading per section, in order of name, and a line per page by rank."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "loc", F.lit(")"))
    rows = sections.join(pages, "page_id").select("site", "section", "rank", line.alias("line"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    parts = rows.groupBy("site", "section").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("## "), "section", F.lit("\n"), "lines")
    whole = F.array_sort(F.collect_list(F.struct("section", block.alias("block"))))
    return parts.groupBy("site").agg(F.array_join(F.transform(whole, lambda x: x["block"]), "\n\n").alias("blocks")).select("site", F.concat(F.lit("# "), "site", F.lit("\n\n"), "blocks").alias("body"))


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """n rows of each site at even strides in the order of page_id; all, if fewer."""
    order, whole = Window.partitionBy("site").orderBy("page_id"), Window.partitionBy("site")
    at, size = F.row_number().over(order) - 1, F.count("*").over(whole)
    marked = rows.withColumns({"at": at, "size": size})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("size") / n))
    return marked.where((F.col("size") <= n) | F.array_contains(picks, F.col("at").cast("long"))).drop("at", "size")


def reports(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, pages, findings, critical, worst): a report row for each site."""
    per = found.groupBy("site").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))
    n = pages.groupBy("site").agg(F.count("*").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(per, "site", "left").select("site", "pages", zero("findings"), zero("critical"), F.coalesce("checks", F.lit("")).alias("checks"))


def sitemap_audit(rows: DataFrame) -> DataFrame:
    """(site, urls, included, health): 100 less capped penalties for rows of each reason."""
    out = rows.groupBy("site").agg(F.count("*").alias("urls"), F.count_if(F.col("verdict") == "Indexable").alias("included"), F.count_if(F.col("verdict").isin("404", "410", "Server error")).alias("broken"), F.count_if(F.col("verdict") == "Redirect").alias("moved"))
    share = lambda c, cap: F.least(F.lit(float(cap)), 100.0 * F.col(c) / F.col("urls"))
    return out.select("site", "urls", "included", tx.half_up(100 - share("broken", 40) - share("moved", 20)).alias("health"))
