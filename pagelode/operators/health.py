"""Link health and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx

RESULT = """CASE WHEN error LIKE '%DNS%' THEN 'dns_error' WHEN error LIKE '%TLS%' THEN 'tls_error' WHEN error LIKE '%timeout%' THEN 'timeout' WHEN status = 404 OR status = 410 THEN 'broken'
 WHEN status IN (401, 403, 429) THEN 'restricted' WHEN status >= 500 THEN 'server_error' WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status BETWEEN 200 AND 299 THEN 'working' ELSE 'unknown' END"""
SEVERITY = """CASE WHEN result = 'broken' AND is_internal THEN 'critical' WHEN result IN ('broken', 'dns_error', 'server_error') THEN 'high' WHEN result IN ('tls_error', 'timeout') THEN 'medium' WHEN result IN ('redirect', 'restricted') THEN 'low' ELSE 'none' END"""


def results(checks: DataFrame) -> DataFrame:
    """checks with (result, severity)."""
    return checks.withColumn("result", F.expr(RESULT)).withColumn("severity", F.expr(SEVERITY))


def health_score(rows: DataFrame) -> DataFrame:
    """(site, links, score): 100 less penalties by severity, each kind capped."""
    n = lambda s: F.count_if(F.col("severity") == s)
    lost = F.least(F.lit(50), 10 * n("critical")) + F.least(F.lit(30), 5 * n("high")) + F.least(F.lit(15), 3 * n("medium")) + F.least(F.lit(10), n("low"))
    return rows.groupBy("site").agg(F.count("*").alias("links"), F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))


def retry_verdict(attempts: Column) -> Column:
    """Of statuses in order: working if any succeeded, confirmed if all say gone, else by the last."""
    return F.when(F.exists(attempts, lambda s: s.between(200, 299)), "working").when(F.forall(attempts, lambda s: s.isin(404, 410)), "confirmed_broken").when(F.element_at(attempts, -1) >= 500, "server_trouble").otherwise("unclear")


def redirects(hops: DataFrame) -> DataFrame:
    """(chain, hops, kind, loop, to_https, cross_host) of hop rows (chain, step, source, target)."""
    host = lambda c: F.regexp_extract(c, "://([^/]+)", 1)
    out = hops.groupBy("chain").agg(
        F.count("*").alias("hops"), F.count_distinct("target").alias("distinct"), F.min_by("source", "step").alias("first"), F.max_by("target", "step").alias("last"),
        F.bool_or(F.startswith("source", F.lit("http:")) & F.startswith("target", F.lit("https:"))).alias("to_https"),
    )
    kind = F.when(F.col("hops") == 1, "single").when(F.col("hops") <= 3, "chain").otherwise("long")
    return out.select("chain", "hops", kind.alias("kind"), (F.col("distinct") < F.col("hops")).alias("loop"), "to_https", (host("first") != host("last")).alias("cross_host"))


def ip_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    return sum((p[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), p[0].cast("long") * 256**3)


def providers(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ips (ip, n) with the provider of the longest range that holds each; ranges (lo, hi, len,
    provider) meet them by their first byte."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    met = ips.withColumn("bucket", F.shiftright("n", 24)).join(spread, "bucket").where("n between lo and hi")
    best = met.groupBy("ip").agg(F.max_by("provider", "len").alias("provider"))
    return ips.join(best, "ip", "left").select("ip", "provider")


def age(since: Column, as_of: Column) -> dict[str, Column]:
    """Whole years and months, and days in all, from a date to another."""
    months = F.floor(F.months_between(as_of, since)).cast("long")
    return {"years": F.floor(months / 12), "months": months % 12, "days": F.datediff(as_of, since).cast("long")}


def expiry(until: Column, as_of: Column) -> Column:
    left = F.datediff(until, as_of)
    return F.when(left < 0, "expired").when(left <= 7, "within 7 days").when(left <= 30, "within 30 days").when(left <= 90, "within 90 days").otherwise("ok")


def version_key(version: Column) -> Column:
    """Dotted numbers as an array that compares like versions."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999999")).cast("long"), F.lit(0)))


def version_state(own: Column, newest: Column) -> Column:
    a, b = version_key(own), version_key(newest)
    return F.when(own.isNull() | newest.isNull(), "unknown").when(a == b, "current").when(a < b, "older").otherwise("newer")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, votes, agreed): the commonest value, ties to the first in order."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(group).orderBy(F.desc("votes"), value)
    return n.withColumns({"r": F.row_number().over(order), "agreed": F.count("*").over(Window.partitionBy(group)) == 1}).where("r = 1").select(group, value, "votes", "agreed")
