"""Connected components of a link table by repeated minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """doc_id and component (smallest doc_id reachable) of every end of ``links`` (a, b).

    Each round takes the least label among the neighbours and then the label of
    that label, so long chains halve. Only "did a label fall" reaches the driver.
    A hub is met by joins whose other side has one row per key, which AQE can
    split. An empty table of links gives an empty result.
    """
    # Both directions from one pass over the links.
    ways = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    edges = checkpointed(links.where("a is not null and b is not null").select(ways).select("way.a", "way.b").distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("doc_id"), F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("far"))
        step = labels.join(near, "doc_id").join(far, "component", "left")
        after = checkpointed(step.select("doc_id", F.least("component", "near", "far").alias("component"), F.col("component").alias("before")))
        changed = not after.where("component < before").isEmpty()
        labels = after.drop("before")
        if not changed:
            return labels
