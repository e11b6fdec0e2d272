"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """node, group (its smallest reachable node) of every end of ``links`` (a, b).

    A round takes the smallest group among a node's neighbours and then the group
    of that group, so a chain of n links needs about log n rounds. The driver only
    learns whether anything changed: a broadcast in each round would pass through it,
    so the joins are merged.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
    edges = checkpointed(links.where("a is not null and b is not null").select(ends.alias("way")).select("way.*").distinct())
    groups = checkpointed(edges.groupBy("node").agg(F.least("node", F.min("near")).alias("group")))
    while True:
        near = edges.join(groups.select(F.col("node").alias("near"), "group").hint("merge"), "near").groupBy("node").agg(F.min("group").alias("_near"))
        far = groups.select(F.col("node").alias("group"), F.col("group").alias("_far"))
        step = groups.join(near.hint("merge"), "node").join(far.hint("merge"), "group", "left")
        after = checkpointed(step.select("node", F.least("group", "_near", "_far").alias("group"), F.col("group").alias("_before")))
        if after.where("group < _before").isEmpty():
            return after.drop("_before")
        groups = after.drop("_before")
