"""The labelled rows a fit gets: one row per document, spread over long ones, up to a limit in all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import checkpointed


LEAST_EACH = 200  # labelled documents of either kind, if there are so many


def labelled(docs: DataFrame, usable: DataFrame, label: str, sample: int, least: int = LEAST_EACH) -> DataFrame:
    """At most ``sample`` rows of ``usable`` (doc_id, ``label`` 0 or 1; an id once) whose document has a text, by least id hashes.

    A kind of label that would get fewer than ``least`` rows gets as many as that
    if there are so many, and the other kind the fewer.
    """
    there = docs.where(F.length("text") > 0).select("doc_id")
    drawn = checkpointed(usable.join(there, "doc_id", "left_semi"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    kinds = [drawn.where(F.col(label) == kind) for kind in (0, 1)]
    counts = [kind.count() for kind in kinds]
    taken = drawn.orderBy(*order).limit(sample).where(F.col(label) == 1).count()
    floor = min(least, sample // 2)
    ones = min(counts[1], max(taken, floor, sample - counts[0]))
    ones = min(ones, max(sample - floor, sample - counts[0]))
    zeros = min(counts[0], sample - ones)
    return kinds[0].orderBy(*order).limit(zeros).unionByName(kinds[1].orderBy(*order).limit(ones))


def one_row_each(docs: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """doc_id, text and ``label`` of every document of ``chosen`` (doc_id, ``label``; small) that ``docs`` has.

    A doc_id on several rows counts once, with the non-empty text of the least hash.
    """
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.struct(F.coalesce(F.length("text"), F.lit(0)) == 0, F.xxhash64("text"))
    return texts.groupBy("doc_id").agg(F.min_by("text", first).alias("text"), F.min(label).alias(label))


def spread(n: int, most: int) -> np.ndarray:
    """Numbers of at most ``most`` of ``n`` rows, evenly spread from the first to the last."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(np.int64)


def fitting(made: DataFrame, limit: int) -> DataFrame:
    """The rows of ``made`` (doc_id, n; at most a sample) that fit into ``limit`` in all, in the order of their id hashes.

    A row that does not fit into what is left is passed over, and the next ones are still tried.
    """
    left, ids = limit, []
    for row in made.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["n"] <= left:
            left -= row["n"]
            ids.append((row["doc_id"],))
    return made.join(F.broadcast(made.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")


def demand_both(docs: DataFrame, usable: DataFrame, label: str) -> None:
    """Raise if ``docs`` has texts of both kinds of ``usable`` (doc_id, ``label``); for fits whose sample has not got both."""
    there = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    if there.select(label).distinct().count() > 1:
        raise ValueError(f"labels of both kinds of {label} are usable, but the documents that fit the limits of the sample have only one")
