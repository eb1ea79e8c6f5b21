"""Page features, vocabulary and inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.functions import urls


def page_features(pages: DataFrame) -> DataFrame:
    """A row of features for each page; html itself goes no further."""
    tag = lambda pattern, g=1: F.regexp_extract("html", pattern, g)
    all_of = lambda pattern, g=1: F.regexp_extract_all("html", F.lit(pattern), F.lit(g))
    rows = pages.select(
        "page_id", "url", urls.site(F.col("url")).alias("site"), urls.scheme(F.col("url")).alias("scheme"), urls.path(F.col("url")).alias("path"),
        tx.plain(tag(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"),
        tag(r"(?i)<html[^>]*\blang=\"([^\"]*)\"").alias("lang"),
        tx.plain(tag(r"(?is)<h1[^>]*>(.*?)</h1>")).alias("h1"), F.size(all_of(r"(?i)<h1[\s>]", 0)).alias("h1_count"),
        F.size(all_of(r"(?i)<p[\s>]", 0)).alias("paragraphs"), F.size(all_of(r"(?i)<img[\s>]", 0)).alias("images"),
        F.size(all_of(r"(?i)<script[\s>]", 0)).alias("scripts"), F.size(all_of(r"(?i)class=\"[^\"]*\bad\b", 0)).alias("ad_slots"),
        F.col("html").rlike(r"(?i)<nav[\s>]").alias("has_nav"), F.col("html").rlike(r"(?i)<footer[\s>]").alias("has_footer"), F.col("html").rlike(r"(?i)name=\"viewport\"").alias("has_viewport"),
        tag(r"(?i)<link[^>]*rel=\"canonical\"[^>]*href=\"([^\"]*)\"").alias("canonical"), F.col("html").rlike(r"(?i)<meta[^>]*noindex").alias("noindex"),
        tx.visible(F.col("html")).alias("visible_text"), tx.main_text(F.col("html")).alias("main_text"), F.octet_length("html").alias("html_bytes"),
    )
    return rows.withColumn("word_count", F.size(tx.words(F.col("main_text"))))


def page_tokens(features: DataFrame, least: int = 1) -> DataFrame:
    """(site, page_id, pos, word): lower-case words of the main texts."""
    rows = features.select("site", "page_id", F.posexplode_outer(tx.words(F.lower("main_text"))).alias("pos", "word"))
    return rows.where(F.length("word") >= least)


def top_keywords(tokens: DataFrame, n: int = 5) -> DataFrame:
    """(page_id, rank, word, uses): commonest topic words of each page, ties to the first seen."""
    counts = tokens.where((F.length("word") >= 4) & ~F.col("word").isin(*tx.STOP_WORDS)).groupBy("page_id", "word").agg(F.count("*").alias("uses"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("uses"), "first", "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("page_id", "rank", "word", "uses")


def repeated_phrases(features: DataFrame, size: int = 3, least: int = 3, top: int = 20) -> DataFrame:
    """(page_id, phrase, uses): stretches of topic words that a page repeats, its `top` commonest."""
    ws = F.filter(tx.words(F.lower("main_text")), lambda w: (F.length(w) > 2) & ~w.isin(*tx.STOP_WORDS))
    # the words are a column by themselves, as a text would be split anew for each use; so it would in the filter
    # on its size that Spark puts before an explode, but for an outer one
    grams = features.select("page_id", ws.alias("ws")).select("page_id", F.posexplode_outer(tx.shingles(F.col("ws"), size)).alias("pos", "phrase")).where("phrase is not null")
    counts = grams.groupBy("page_id", "phrase").agg(F.count("*").alias("uses"), F.min("pos").alias("first")).where(F.col("uses") >= least)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("uses"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("page_id", "phrase", "uses")


def vocabulary(features: DataFrame, share: float = 0.6) -> DataFrame:
    """(site, word, on): visible words of three signs or more on most pages of a site of two pages or more."""
    pages = features.groupBy("site").agg(F.count("*").alias("n")).where("n >= 2")
    seen = features.select("site", "page_id", F.explode_outer(F.array_distinct(F.split(F.lower("visible_text"), "[^a-z0-9']+"))).alias("word")).where(F.length("word") >= 3)
    return seen.groupBy("site", "word").agg(F.count("*").alias("on")).join(pages, "site").where(F.col("on") >= F.ceil(share * F.col("n"))).select("site", "word", "on")


def unique_words(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """(site, page_id, unique_words, boilerplate_ratio): distinct topic words of the main text outside the
    site's vocabulary, and the share of visible words that lie in it."""
    tokens = lambda c, side: features.select("site", "page_id", F.lit(side).alias("side"), F.explode_outer(tx.words(F.lower(c))).alias("word")).where("word is not null")
    counts = tokens("main_text", 0).union(tokens("visible_text", 1)).groupBy("site", "page_id", "side", "word").agg(F.count("*").alias("n"))
    marked = counts.join(vocab.select("site", "word", F.lit(1).alias("shared")), ["site", "word"], "left")
    topic = (F.col("side") == 0) & F.col("shared").isNull() & (F.length("word") >= 4) & ~F.col("word").isin(*tx.STOP_WORDS)
    visible = lambda more: F.sum(F.when((F.col("side") == 1) & more, F.col("n")))
    sums = marked.groupBy("page_id").agg(F.count_if(topic).alias("u"), visible(F.col("shared").isNotNull()).alias("s"), visible(F.lit(True)).alias("n"))
    rows = features.select("site", "page_id", "word_count").join(sums, "page_id", "left")
    return rows.select("site", "page_id", "word_count", F.coalesce("u", F.lit(0)).alias("unique_words"), F.coalesce(tx.half_up(F.col("s") / F.col("n"), 4), F.lit(0.0)).alias("boilerplate_ratio"))


#: A content page under either limit is empty; below these unique words it is thin, thin but
#: with some weight, or full; from the fourth on it counts as useful.
INVENTORY = {"words": 20, "empty": 10, "thin": 50, "full": 90, "useful": 70}


def inventory(unique: DataFrame, content: Column, limits: dict[str, int] = INVENTORY) -> DataFrame:
    """Per site: its pages, those that are content, these by band, and their weighted usefulness in percent."""
    u = F.col("unique_words")
    weight = F.when((F.col("word_count") < limits["words"]) | (u < limits["empty"]), 0.0).when(u < limits["thin"], 0.2).when(u < limits["full"], 0.55).otherwise(1.0)
    rows = unique.withColumns({"content": content, "w": F.when(content, weight)})
    out = rows.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if("content").alias("content_pages"), F.count_if(F.col("w") == 0).alias("empty"), F.count_if((F.col("w") > 0) & (F.col("w") < 1)).alias("thin"),
        F.count_if((F.col("w") == 1) | (F.col("w") == 0.55) & (u >= limits["useful"])).alias("useful"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"),
    )
    return out.select("site", "pages", "content_pages", "empty", "thin", "useful", tx.pct(F.col("w"), F.col("content_pages")).alias("useful_pct"), tx.pct((F.col("empty") + F.col("thin")).cast("double"), F.col("content_pages")).alias("thin_pct"))


def duplicates_of(features: DataFrame, column: str, spelled: bool = False) -> DataFrame:
    """(site, value, pages): values of a column that several pages of a site share, case and outer
    space aside; with `spelled`, each spelling counts by itself."""
    by = ["site", F.lower(F.trim(F.col(column))).alias("value"), *([F.col(column).alias("spelling")] if spelled else [])]
    return features.groupBy(*by).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1 and value <> ''").drop("spelling")


def cannibalised(keywords: DataFrame, features: DataFrame) -> DataFrame:
    """(site, word, pages): primary keywords of two pages or more."""
    first = keywords.where("rank = 1").join(features.select("page_id", "site"), "page_id")
    return first.groupBy("site", "word").agg(F.count("*").alias("pages")).where("pages > 1")


def repeated_sentences(features: DataFrame, least: int = 30) -> DataFrame:
    """(page_id, most): how often a page's most repeated long sentence occurs."""
    rows = features.select("page_id", F.explode_outer(F.transform(tx.sentences(F.col("main_text")), lambda s: F.lower(F.trim(s)))).alias("s")).where(F.length("s") > least)
    return rows.groupBy("page_id", "s").count().groupBy("page_id").agg(F.max("count").alias("most"))
