"""Connected components of a table of links, beside what cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.operators.lineage import checkpoint, shared_folder, stored

__all__ = ["checkpoint", "components", "shared_folder", "stored"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Each round a node takes the least label of its neighbours, then its label's own label, so that
    paths halve; a few rounds do for stars and short chains. Links that are null, repeated, reversed
    or loops do no harm; no links give an empty table."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpoint(pairs.union(pairs.select("b", "a")).distinct().toDF("a", "b"))
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        closer = labels.join(least, labels.node == least.a).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        of = labels.select(F.col("node").alias("at"), F.col("component").alias("on"))
        jumped = closer.join(of, closer.component == of["at"]).select("node", "was", F.least("component", "on").alias("component"))
        new = checkpoint(jumped)
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
