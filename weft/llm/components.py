"""Connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import forget, hot_keys, salted, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of links (a, b) reaches.

    Each round takes the least label of all neighbours (pre-aggregated in each
    task, so that a hub costs one row a task), then the label's own label; the
    rounds grow with the logarithm of the longest chain.  The edges of a hub, and
    the members of a giant component, are salted over many tasks.  Labels are
    written after each round.  Null ends are ignored; a link to itself is a
    component."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").toDF("a", "b").distinct())
    hubs = hot_keys(edges, ["b"])
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = salted(edges, labels.withColumnRenamed("id", "b"), ["b"], "inner", hubs).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hop = written(labels.join(near, "id").select("id", "label", F.least("label", "near").alias("hop")))
        own = labels.select(F.col("id").alias("hop"), F.col("label").alias("jump"))
        after = written(salted(hop, own, ["hop"], "inner", hot_keys(hop, ["hop"])).select("id", F.least("hop", "jump").alias("label"), F.col("label").alias("before")))
        changed = after.where("label <> before").limit(1).count()
        forget(labels, hop)
        if not changed:
            forget(edges)
            return after.select(F.col("id"), F.col("label").alias("component"))
        labels = after
