"""Structured data of pages as VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators.lineage import stored

_BLOCK = r"""(?is)<script\b(?=[^>]*type=["']application/ld\+json["'])[^>]*>(.*?)</script>"""


def _list(v: Column, path: str) -> Column:
    """The array at a path as variants; null if none is there."""
    return F.try_variant_get(v, path, "array<variant>")


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, block, v): each JSON-LD block of a page; v is null where it isn't JSON."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))).alias("block", "text")).select("page_id", "block", F.try_parse_json(F.trim("text")).alias("v"))


def objects(found: DataFrame) -> DataFrame:
    """(page_id, place, types, v): the objects of all blocks, in arrays and, to any depth, in `@graph`; place
    is the way to each, in order, and types are in lower case. Malformed blocks have none."""
    top = F.coalesce(_list(F.col("v"), "$"), F.array("v"))
    level = stored(found.where("v is not null").select("page_id", "block", F.posexplode(top).alias("at", "v")).select("page_id", F.array("block", "at").alias("place"), "v"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        inner = level.select("page_id", "place", F.posexplode(_list(F.col("v"), '$["@graph"]')).alias("at", "v"))
        level = stored(inner.select("page_id", F.concat("place", F.array("at")).alias("place"), "v"))
    rows = reduce(DataFrame.unionByName, levels) if levels else level
    kinds = F.coalesce(F.try_variant_get("v", '$["@type"]', "array<string>"), F.array(_string(F.col("v"), '$["@type"]')))
    return rows.select("page_id", "place", F.transform(F.array_compact(kinds), F.lower).alias("types"), "v")


def types(objs: DataFrame) -> DataFrame:
    """(page_id, types): the distinct types of a page, sorted."""
    return objs.select("page_id", F.explode("types").alias("type")).groupBy("page_id").agg(F.sort_array(F.collect_set("type")).alias("types"))


def field(objs: DataFrame, kind: str, name: str) -> DataFrame:
    """(page_id, value): the field of the first object of that type that has it, white space collapsed."""
    value = F.trim(F.regexp_replace(_string(F.col("v"), f'$["{name}"]'), r"\s+", " "))
    rows = objs.where(F.array_contains("types", kind)).select("page_id", "place", value.alias("value")).where("value is not null")
    return rows.groupBy("page_id").agg(F.min_by("value", "place").alias("value"))


def breadcrumbs(pages: DataFrame, objs: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, crumbs, source): the names of the first breadcrumb list in the structured data, else the
    items of the page's breadcrumb element; pages with neither have no row."""
    name = lambda x: F.trim(F.regexp_replace(F.coalesce(F.nullif(_string(x, "$.name"), F.lit("")), _string(x, "$.item.name"), F.lit("")), r"\s+", " "))
    lists = objs.where(F.array_contains("types", "breadcrumblist")).select("page_id", "place", _list(F.col("v"), "$.itemListElement").alias("items")).where("items is not null")
    named = lists.select("page_id", "place", F.filter(F.transform("items", name), lambda n: n != "").alias("crumbs"))
    data = named.groupBy("page_id").agg(F.min_by("crumbs", "place").alias("data"))
    part = lambda tag, attr: F.nullif(F.regexp_extract(html, rf"""(?is)<({tag})\b[^>]*(?:{attr})=["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</\1>""", 2), F.lit(""))
    items = F.regexp_extract_all(F.coalesce(part("nav", "aria-label|class"), part("ol|ul", "class")), F.lit(r"(?is)<(?:li|span)\b[^>]*>(.*?)</(?:li|span)>"), F.lit(1))
    shown = F.filter(F.transform(items, tx.plain), lambda t: t != "")
    rows = pages.select("page_id", F.when(F.size(shown) > 0, shown).alias("shown")).join(data, "page_id", "left")
    return rows.select("page_id", F.coalesce("data", "shown").alias("crumbs"), F.when(F.col("data").isNotNull(), "data").otherwise("html").alias("source")).where("crumbs is not null")


def block_errors(found: DataFrame) -> DataFrame:
    """(page_id, blocks, errors): how many blocks a page has, and how many aren't JSON."""
    return found.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("v").isNull()).alias("errors"))
