"""Queries on page loads that follow from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions import text as tx
from pagelode.operators import vitals as vt
from pagelode.plans import duck as d
from pagelode.sources.tables import read_table
from pagelode.streaming import events as st

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def events(spark, sf):
    return read_table(spark, sf, "events").withColumn("ms", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)").cast("double"))


_E = "ev AS (SELECT *, CAST(epoch_ms(ts) AS DOUBLE) AS ms, CAST(ts AS DATE) AS day FROM events)"
_LOAD = "user_id * 100 + dayofmonth(ts)"


def loads(spark, sf):
    """A load for each user and day: its events in time order as layout shifts, a thousandth of the time."""
    e = events(spark, sf).select(F.expr(_LOAD).alias("load_id"), "user_id", "event_type", "value", "ms", "event_id")
    shift = F.struct((F.floor(F.col("ms") / 1000) % 86400).cast("double").alias("start"), (F.col("event_id") % 40).cast("double").alias("duration"), (F.col("value") / 1000).alias("value"))
    lcp = F.max(F.when(F.col("event_type") == "view", F.col("value") * 100))
    return e.groupBy("load_id", "user_id").agg(F.array_sort(F.collect_list(shift)).alias("shifts"), lcp.alias("lcp"), F.max(F.when(F.col("event_type") == "click", F.col("value") * 10)).alias("inp"), F.min(F.when(F.col("event_type") == "purchase", F.col("value") * 50)).alias("ttfb"))


_SHIFTS = f"""{_E}, sh AS (SELECT {_LOAD} AS load_id, user_id, (floor(ms / 1000) % 86400) AS s, CAST(event_id % 40 AS DOUBLE) AS d, value / 1000 AS v, event_id FROM ev),
nu AS (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY s, d, v) AS n FROM sh),
wn(load_id, n, beg, fin, tot, best) AS (SELECT load_id, n, s, s + d, v, v FROM nu WHERE n = 1
 UNION ALL SELECT w.load_id, nu.n, CASE WHEN nu.s - w.fin > 1000 AND w.fin - w.beg > 5000 THEN nu.s ELSE w.beg END, CASE WHEN nu.s - w.fin > 1000 AND w.fin - w.beg > 5000 THEN nu.s + nu.d ELSE greatest(w.fin, nu.s + nu.d) END,
  CASE WHEN nu.s - w.fin > 1000 AND w.fin - w.beg > 5000 THEN nu.v ELSE w.tot + nu.v END, greatest(w.best, CASE WHEN nu.s - w.fin > 1000 AND w.fin - w.beg > 5000 THEN nu.v ELSE w.tot + nu.v END) FROM wn AS w JOIN nu ON nu.load_id = w.load_id AND nu.n = w.n + 1),
cl AS (SELECT load_id, {d.half_up('max(best)', 4)} AS cls FROM wn GROUP BY load_id),
lo AS (SELECT {_LOAD} AS load_id, user_id, max(CASE WHEN event_type = 'view' THEN value * 100 END) AS lcp, max(CASE WHEN event_type = 'click' THEN value * 10 END) AS inp, min(CASE WHEN event_type = 'purchase' THEN value * 50 END) AS ttfb FROM ev GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_SHIFTS} SELECT load_id, cls FROM cl")
def layout_shift(spark: SparkSession, sf: str) -> DataFrame:
    return vt.shift_windows(loads(spark, sf)).select("load_id", "cls")


def _case(m):
    _, g, p, _ = next(t for t in vt.THRESHOLDS if t[0] == m)
    return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} <= {g} THEN 'good' WHEN {m} <= {p} THEN 'needs improvement' ELSE 'poor' END"


@query(f"WITH {_SHIFTS.split(', sh AS')[0]}, lo AS {_SHIFTS.split('lo AS ')[1]} SELECT load_id, {_case('lcp')} AS lcp, {_case('inp')} AS inp, {_case('ttfb')} AS ttfb FROM lo")
def vitals_classes(spark: SparkSession, sf: str) -> DataFrame:
    return loads(spark, sf).select("load_id", *[vt.classify(F.col(m), m).alias(m) for m in ("lcp", "inp", "ttfb")])


def _line(m):
    _, g, p, _ = next(t for t in vt.THRESHOLDS if t[0] == m)
    return f"least(100.0, greatest(0.0, 100 - 50 * ({m} - {g}) / ({p} - {g})))"


_SCORE = f"""{_SHIFTS}, ps AS (SELECT lo.load_id, lo.user_id, {d.half_up('(' + ' + '.join(f"coalesce({_line(m)} * {w} * CASE WHEN {m} IS NULL THEN NULL ELSE 1 END, 0)" for m, _, _, w in vt.THRESHOLDS) + ') / (' + ' + '.join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {w} END" for m, _, _, w in vt.THRESHOLDS) + ')')} AS score FROM lo JOIN cl ON cl.load_id = lo.load_id)""".replace("lo.load_id, lo.user_id, floor", "lo.load_id, lo.user_id, floor")


@query(f"WITH RECURSIVE {_SCORE} SELECT load_id, CAST(score AS DOUBLE) AS score FROM ps")
def performance_score(spark: SparkSession, sf: str) -> DataFrame:
    return vt.performance(vt.shift_windows(loads(spark, sf))).select("load_id", "score")


@query(f"WITH RECURSIVE {_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, load_id) AS rank FROM ps WHERE score IS NOT NULL) SELECT user_id, CAST(rank AS INTEGER) AS rank, load_id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 3")
def worst_loads(spark: SparkSession, sf: str) -> DataFrame:
    return vt.worst_loads(vt.performance(vt.shift_windows(loads(spark, sf))))


def tasks(spark, sf):
    return events(spark, sf).where("event_type = 'error'").select(F.expr(_LOAD).alias("load_id"), F.col("event_id").alias("id"), "ms", (F.floor(F.col("ms") / 1000) % 86400).cast("double").alias("start"), (F.col("value") * 20).alias("duration"), F.get_json_object("props", "$.k").alias("source"))


def interactions(spark, sf):
    e = events(spark, sf).where("event_type = 'click'")
    part = lambda n: (F.col("event_id") % n).cast("double")
    return e.select(F.expr(_LOAD).alias("load_id"), F.col("event_id").alias("id"), (F.floor(F.col("ms") / 1000) % 86400).cast("double").alias("start"), (F.col("value") * 50).alias("latency"), part(7).alias("delay"), part(11).alias("processing"), part(13).alias("presentation"), (F.col("event_id") % 5 != 0).alias("responded"))


_TASKS = f"""{_E}, ta AS (SELECT {_LOAD} AS load_id, event_id AS id, floor(ms / 1000) % 86400 AS start, value * 20 AS duration, json_extract_string(props, '$.k') AS source FROM ev WHERE event_type = 'error'),
it AS (SELECT {_LOAD} AS load_id, event_id AS id, floor(ms / 1000) % 86400 AS start, value * 50 AS latency, event_id % 7 AS de, event_id % 11 AS pr, event_id % 13 AS pe, event_id % 5 <> 0 AS ok FROM ev WHERE event_type = 'click')"""


@query(f"WITH {_TASKS} SELECT load_id, max(latency) AS inp, arg_max(CASE WHEN de >= pr AND de >= pe THEN 'delay' WHEN pr >= pe THEN 'processing' ELSE 'presentation' END, (latency, start)) AS phase FROM it WHERE ok GROUP BY load_id")
def slowest_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return vt.worst_interaction(interactions(spark, sf))


@query(f"WITH {_TASKS} SELECT ta.load_id, ta.id AS task, it.id AS interaction FROM ta JOIN it ON ta.load_id = it.load_id AND ta.start + duration >= it.start AND ta.start <= it.start + latency")
def task_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return vt.overlaps(tasks(spark, sf), interactions(spark, sf))


@query(f"WITH {_TASKS} SELECT load_id, source, count(*) AS tasks, round(sum(duration), 6) AS total, max(duration) AS longest, round(sum(greatest(0, duration - 50)), 6) AS blocking FROM ta GROUP BY ALL")
def blocking_time(spark: SparkSession, sf: str) -> DataFrame:
    return vt.blocking(tasks(spark, sf)).withColumns({c: F.round(c, 6) for c in ("total", "blocking")})


def resources(spark, sf):
    """A resource for each event, with the type, host and cache header that follow from its numbers."""
    e = read_table(spark, sf, "events")
    cache = F.expr("CASE event_id % 6 WHEN 0 THEN 'no-store' WHEN 1 THEN 'public, max-age=31536000' WHEN 2 THEN 'max-age=600' WHEN 3 THEN 'no-cache' WHEN 4 THEN 'max-age=86400' END")
    return e.select(F.col("user_id").alias("load_id"), F.col("event_type").alias("type"), F.floor(F.col("value") * 100).alias("bytes"), F.floor(F.col("value")).alias("start"), F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("host"), F.concat(F.lit("h"), (F.col("user_id") % 9).cast("string")).alias("page_host"), cache.alias("cache_control"))


_RES = "re AS (SELECT user_id AS load_id, event_type AS type, CAST(floor(value * 100) AS BIGINT) AS bytes, CAST(floor(value) AS BIGINT) AS start, 'h' || (event_id % 9) AS host, 'h' || (user_id % 9) AS page_host, event_id % 6 AS c FROM events)"


@query(f"WITH {_RES} SELECT load_id, type, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM re GROUP BY GROUPING SETS ((load_id, type), (load_id))")
def waterfall_totals(spark: SparkSession, sf: str) -> DataFrame:
    return vt.waterfall(resources(spark, sf))


@query(f"WITH {_RES} SELECT type, count(*) AS resources, count(*) FILTER (c = 1) AS long_lived, count(*) FILTER (c IN (0, 2, 3)) AS short, count(*) FILTER (c = 5) AS none FROM re GROUP BY type")
def cache_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return vt.cache_coverage(resources(spark, sf))


@query(f"WITH {_RES} SELECT host, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, min(start) AS earliest FROM re WHERE host <> page_host GROUP BY host")
def third_party_cost(spark: SparkSession, sf: str) -> DataFrame:
    return vt.third_parties(resources(spark, sf))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events) SELECT day, event_type, count(*) AS n, count(*) FILTER (value <= 10) AS good, count(*) FILTER (value > 10 AND value <= 25) AS fair, count(*) FILTER (value > 25) AS poor FROM e GROUP BY day, event_type""")
def stream_vitals(spark: SparkSession, sf: str) -> DataFrame:
    """T3, by a stream over the event files until they are all read."""
    return st.drain(st.vitals_by_window(st.read_events(spark, sf), "1 day"), "stream_vitals", "complete").select("day", "event_type", "n", "good", "fair", "poor")


@query("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """T5, first occurrence of a key, by a stream that keeps the least time of each."""
    return st.drain(st.first_seen(st.read_events(spark, sf)), "stream_dedup", "complete")


@query("SELECT event_type, count(*) AS crawled, count(DISTINCT user_id) AS discovered FROM events GROUP BY event_type")
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """T6, counters of a stream; the distinct count follows from first occurrences."""
    return st.drain(st.progress(st.read_events(spark, sf)), "stream_progress", "complete").groupBy("event_type").agg(F.sum("n").alias("crawled"), F.count("*").alias("discovered"))


def _admission(events_sql: str, n: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r(user_id, k, kept, ok) AS (SELECT user_id, k, [t], true FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, CASE WHEN len([x for x in r.kept if x > e.t - 864000000000]) < {n} THEN list_append([x for x in r.kept if x > e.t - 864000000000], e.t) ELSE [x for x in r.kept if x > e.t - 864000000000] END,
  len([x for x in r.kept if x > e.t - 864000000000]) < {n} FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT r.user_id, count(*) AS asked, count(*) FILTER (ok) AS admitted FROM r GROUP BY r.user_id"""


@query(_admission("events", 8))
def stream_admission(spark: SparkSession, sf: str) -> DataFrame:
    """T1, sliding-window admission per user: eight in ten days, by a stream that keeps each user's times."""
    e = st.read_events(spark, sf).select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("t"))
    return st.drain(st.admission_stream(e, 8, 10 * 86_400_000_000), "stream_admission", "append").groupBy("user_id").agg(F.count("*").alias("asked"), F.count_if("admitted").alias("admitted"))


@query("""WITH r AS (SELECT user_id, ts, event_id, count(*) OVER w AS n, sum(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, count(*) AS events, count(*) FILTER (n <= 20 AND v <= 400) AS within FROM r GROUP BY user_id""")
def resource_budget(spark: SparkSession, sf: str) -> DataFrame:
    """T4, per user at most 20 events and 400 of value."""
    return st.within_budget(read_table(spark, sf, "events"), 20, 400.0).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("within").alias("within"))


@query(ORACLES["resource_budget"])
def stream_budget(spark: SparkSession, sf: str) -> DataFrame:
    """T4 by a stream that keeps each user's count and value."""
    e = st.read_events(spark, sf).select("user_id", "event_id", "ts", "value")
    return st.drain(st.budget_stream(e, 20, 400.0), "stream_budget", "append").groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("within").alias("within"))


@query(ORACLES["layout_shift"])
def stream_layout_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of layout_shift by a stream that keeps each load's shifts."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)").cast("double")
    e = st.read_events(spark, sf).select(F.expr(_LOAD).cast("long").alias("load_id"), (F.floor(ms / 1000) % 86400).cast("double").alias("start"), (F.col("event_id") % 40).cast("double").alias("duration"), (F.col("value") / 1000).alias("value"))
    return st.drain(st.shift_stream(e), "stream_layout_shift", "update", "load_id").select("load_id", tx.half_up(F.col("best"), 4).alias("cls"))
