"""Page-load timing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx

GAP_MS, OPEN_MS = 1000, 5000
#: Metric, good up to, poor above, weight.
THRESHOLDS = (("lcp", 2500.0, 4000.0, 0.35), ("inp", 200.0, 500.0, 0.3), ("cls", 0.1, 0.25, 0.25), ("ttfb", 800.0, 1800.0, 0.1))


def largest_window(shifts: Column) -> Column:
    """The largest sum of a session window over shifts (start, duration, value). A window ends when the gap
    to the next shift is over GAP_MS and it has been open over OPEN_MS."""
    empty = F.struct(*[F.lit(0.0).alias(c) for c in ("begin", "end", "sum", "best")], F.lit(False).alias("open"))

    def step(s, x):
        split = ~s["open"] | ((x["start"] - s["end"] > GAP_MS) & (s["end"] - s["begin"] > OPEN_MS))
        end, total = x["start"] + F.coalesce(x["duration"], F.lit(0.0)), F.when(split, x["value"]).otherwise(s["sum"] + x["value"])
        return F.struct(F.when(split, x["start"]).otherwise(s["begin"]).alias("begin"), F.when(split, end).otherwise(F.greatest(s["end"], end)).alias("end"), total.alias("sum"), F.greatest(s["best"], total).alias("best"), F.lit(True).alias("open"))

    return F.aggregate(F.array_sort(shifts), empty, step)["best"]


def shift_windows(loads: DataFrame, shifts: str = "shifts") -> DataFrame:
    """loads with `cls`, the largest window of their shifts."""
    return loads.withColumn("cls", tx.half_up(largest_window(F.col(shifts)), 4))


def worst_interaction(interactions: DataFrame) -> DataFrame:
    """(load_id, inp, phase): the slowest answered interaction and its longest phase."""
    rows = interactions.where("responded")
    worst = rows.groupBy("load_id").agg(F.max_by(F.struct("delay", "processing", "presentation", "latency"), F.struct("latency", "start")).alias("w"))
    phase = F.when((F.col("w.delay") >= F.col("w.processing")) & (F.col("w.delay") >= F.col("w.presentation")), "delay").when(F.col("w.processing") >= F.col("w.presentation"), "processing").otherwise("presentation")
    return worst.select("load_id", F.col("w.latency").alias("inp"), phase.alias("phase"))


def overlaps(tasks: DataFrame, interactions: DataFrame) -> DataFrame:
    """(load_id, task, interaction): long tasks that overlap an interaction in time."""
    t = tasks.select("load_id", F.col("id").alias("task"), F.col("start").alias("t0"), (F.col("start") + F.col("duration")).alias("t1"))
    i = interactions.select("load_id", F.col("id").alias("interaction"), F.col("start").alias("i0"), (F.col("start") + F.col("latency")).alias("i1"))
    return t.join(i, "load_id").where("t1 >= i0 and t0 <= i1").select("load_id", "task", "interaction")


def congestion(tasks: DataFrame, interactions: DataFrame, within: float = 2000.0, least: int = 2) -> DataFrame:
    """(load_id, interaction, tasks, total): the slowest answered interaction of each load (ties: the first)
    with the long tasks that start from `within` ms before it to `within` after its end, if they are
    `least`. Tasks meet it by time buckets of twice that width, not all tasks of the load."""
    worst = interactions.where("responded").groupBy("load_id").agg(F.min_by(F.struct("id", "start", "latency"), F.struct(-F.col("latency"), "start", "id")).alias("w"))
    span = worst.select("load_id", F.col("w.id").alias("interaction"), (F.col("w.start") - within).alias("low"), (F.col("w.start") + F.col("w.latency") + within).alias("high"))
    bucket = lambda t: F.floor(t / (2 * within))
    spread = span.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    met = tasks.withColumn("bucket", bucket(F.col("start"))).join(spread, ["load_id", "bucket"]).where("start between low and high")
    return met.groupBy("load_id", "interaction").agg(F.count("*").alias("tasks"), F.sum("duration").alias("total")).where(F.col("tasks") >= least)


def blocking(tasks: DataFrame) -> DataFrame:
    """(load_id, source, tasks, total, longest, blocking): long tasks by source; blocking is what
    passes 50 ms of each."""
    return tasks.groupBy("load_id", "source").agg(F.count("*").alias("tasks"), F.sum("duration").alias("total"), F.max("duration").alias("longest"), F.sum(F.greatest(F.lit(0.0), F.col("duration") - 50)).alias("blocking"))


def classify(value: Column, metric: str) -> Column:
    _, good, poor, _ = next(t for t in THRESHOLDS if t[0] == metric)
    return F.when(value.isNull(), "unavailable").when(value <= good, "good").when(value <= poor, "needs improvement").otherwise("poor")


def metric_score(value: Column, metric: str) -> Column:
    """100 up to good, 50 at poor, falling on to 0; null if unmeasured."""
    _, good, poor, _ = next(t for t in THRESHOLDS if t[0] == metric)
    line = 100 - 50 * (value - good) / (poor - good)
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), line)))


def performance(loads: DataFrame) -> DataFrame:
    """loads with `score`: the mean of the measured metrics by weight; null without a core one."""
    parts = [(metric_score(F.col(m), m), w) for m, _, _, w in THRESHOLDS]
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    # whole hundredths, as sums of the fractions may pass or miss a half
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), round(100 * w)).otherwise(0) for s, w in parts]) / 100.0
    core = F.coalesce("lcp", "inp", "cls").isNotNull()
    return loads.withColumn("score", F.when(core, tx.half_up(total / weight)))


def waterfall(resources: DataFrame) -> DataFrame:
    """(load_id, type, requests, bytes): totals by type and, with type null, in all."""
    return resources.rollup("load_id", "type").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes")).where("load_id is not null")


def cache_ttl(header: Column) -> Column:
    """Seconds that a Cache-Control header allows; null if it says nothing."""
    age = F.regexp_extract(header, r"max-age=(\d+)", 1)
    return F.when(F.contains(header, F.lit("no-store")), 0).when(age != "", F.try_to_number(age, F.lit("999999999999")).cast("long")).when(F.contains(header, F.lit("no-cache")), 0)


def cache_coverage(resources: DataFrame) -> DataFrame:
    """(type, resources, long_lived, short, none): how long answers may be kept."""
    ttl = cache_ttl(F.col("cache_control"))
    return resources.withColumn("ttl", ttl).groupBy("type").agg(F.count("*").alias("resources"), F.count_if(F.col("ttl") >= 604800).alias("long_lived"), F.count_if(F.col("ttl") < 3600).alias("short"), F.count_if(F.col("ttl").isNull()).alias("none"))


def third_parties(resources: DataFrame) -> DataFrame:
    """(host, requests, bytes, earliest): cost of hosts other than the page's own."""
    return resources.where("host <> page_host").groupBy("host").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.min("start").alias("earliest"))


def worst_loads(loads: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, rank, load_id, score): the k lowest scores of each user, nulls left out."""
    order = Window.partitionBy("user_id").orderBy("score", "load_id")
    return loads.where("score is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("user_id", "rank", "load_id", "score")
