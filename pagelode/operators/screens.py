"""Pattern screens over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (category, pattern, hits from which it counts); patterns for Java and RE2 alike.
POLICY = (
    ("gambling", r"(?i)(casino|roulette|betting|jackpot)", 1),
    ("adult", r"(?i)(porn|xxx|escort)", 1),
    ("weapons", r"(?i)(firearm|ammunition|rifle)", 1),
    ("licence", r"(?i)(copyright|licen[cs]ed?|all rights reserved)", 1),
    ("credentials", r"(?i)(password|secret|token|api_?key)", 1),
    ("shouting", r"[A-Z]{4,}!!", 3),
)
INTENTS = (
    ("Informational", r"(?i)(how to|what is|guide|tutorial)"),
    ("Transactional", r"(?i)(buy|price|order|discount)"),
    ("Commercial", r"(?i)(best|review|compare|versus)"),
    ("Navigational", r"(?i)(login|contact|account)"),
    ("Local", r"(?i)(near me|opening hours|directions)"),
)


def policy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, hits, confidence): screens that a text trips. The rules are few and fixed, so
    that each text is scanned where it is."""
    rules = [F.struct(F.lit(c).alias("category"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long").alias("hits"), F.lit(n).alias("least")) for c, p, n in POLICY]
    rows = docs.select(key, F.explode(F.array(*rules)).alias("r")).where("r.hits >= r.least")
    return rows.select(key, "r.category", "r.hits", F.least(F.lit(95), 50 + 10 * F.col("r.hits")).alias("confidence"))


def entities(text: Column) -> Column:
    """Distinct runs of two to four capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"), F.lit(0)))


def intents(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in INTENTS]))


def scripts(docs: DataFrame) -> DataFrame:
    """Documents by source and language, and how many hold letters of some scripts."""
    has = lambda p, n: F.count_if(F.col("text").rlike(p)).alias(n)
    return docs.groupBy("source", "lang").agg(F.count("*").alias("docs"), has(r"\p{IsCyrillic}", "cyrillic"), has(r"\p{IsGreek}", "greek"), has("[àâçéèêëîïôûùüÿœ]", "accented"))


def contacts(docs: DataFrame, key: str, text: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("long")
    return docs.select(key, F.col(text).rlike("(?i)lorem ipsum").alias("lorem"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), n(r"\+?[0-9][0-9 ()-]{7,}[0-9]").alias("phones"))


def freshness(docs: DataFrame, key: str, text: str, as_of: int) -> DataFrame:
    """Latest year that a text names, and its age."""
    years = F.regexp_extract_all(text, F.lit("(19[0-9][0-9]|20[0-9][0-9])"), F.lit(1))
    latest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    return docs.select(key, latest.alias("latest_year"), (F.lit(as_of) - latest).alias("age")).where("latest_year is not null")
