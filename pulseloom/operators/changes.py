"""Change sets: rows that name what they change by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_request(changes: DataFrame) -> DataFrame:
    """One row per id, as requests are served in order and the last wins.

    The order is ``pos``; without that column, or at equal ``pos``, the largest row
    as text counts, so that a rerun gives the same.
    """
    first = [F.col("pos")] if "pos" in changes.columns else []
    others = [c for c in changes.columns if c != "id"]
    last = F.max_by(F.struct(*others), F.struct(*first, F.to_json(F.struct(*others)).alias("_text")))
    return changes.groupBy("id").agg(last.alias("_last")).select("id", "_last.*")
