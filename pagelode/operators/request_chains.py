"""Chains of requests that wait for one another.

Depths come by pointer doubling: each round a request's pointer jumps as far again, so that rounds are
the logarithm of the longest chain. Requests on a cycle, or behind one, never reach a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.operators.lineage import stored


def jumps(requests: DataFrame) -> list[DataFrame]:
    """Tables (load_id, node, up, hops), the k-th with each request's 2^k-th initiator: where `up` is null,
    `hops` is the way to the document. An initiator that is no request of the load counts as none."""
    once = requests.groupBy("load_id", "node").agg(F.min("parent").alias("parent"))
    known = once.select("load_id", F.col("node").alias("parent"), F.lit(1).alias("hops"))
    first = once.join(known, ["load_id", "parent"], "left").select("load_id", "node", F.when(F.col("hops") == 1, F.col("parent")).alias("up"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))
    tables = [stored(first)]
    most = tables[0].groupBy("load_id").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(tables) - 1 < most and not tables[-1].where("up is not null").isEmpty():
        now = tables[-1]
        on = now.select("load_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"))
        tables.append(stored(now.join(on, ["load_id", "up"], "left").select("load_id", "node", F.col("next").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))))
    return tables


def depths(tables: list[DataFrame]) -> DataFrame:
    """(load_id, node, depth): the requests from the document, of depth 1, to each; none on cycles."""
    return tables[-1].where("up is null").select("load_id", "node", (F.col("hops") + 1).alias("depth"))


def longest_chains(requests: DataFrame) -> DataFrame:
    """(load_id, length, path): of each load the longest chain of requests (load_id, node, parent), from the
    document on; of several the one to the least request. Repeated requests count once, with the least
    initiator; a load of cycles alone has no row."""
    tables = jumps(requests)
    last = depths(tables).groupBy("load_id").agg(F.max("depth").alias("length"), F.min_by("node", F.struct(-F.col("depth"), "node")).alias("node"))
    way = last.select("load_id", "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(tables))):  # every distance is one sum of powers of two
        step = way.join(tables[k].where("up is not null").select("load_id", "node", "up"), ["load_id", "node"])
        way = stored(way.union(step.select("load_id", F.col("up").alias("node"), F.col("back") + (1 << k))))
    path = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))), lambda x: x["node"])
    return last.drop("node").join(way.groupBy("load_id").agg(path.alias("path")), "load_id")
