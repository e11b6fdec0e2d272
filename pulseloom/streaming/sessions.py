"""Session windows over a stream of valid signals, and the repair of late ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.analysis import max_severity
from pulseloom.operators.sessions import DEFAULT_WINDOW_US, SESSION_KEYS, cell_of, session_summary
from pulseloom.session import broadcast_if_small, checkpointed

DAY_US = 86_400_000_000


def stream_sessions(signals: DataFrame, watermark: str = "10 minutes", window_us: int = DEFAULT_WINDOW_US) -> DataFrame:
    """Closed sessions of a stream, in append mode, with the columns of the batch form.

    A pause of exactly the window still belongs to the session, and a session
    window closes at its gap, so the gap is one microsecond longer. Repeated ids
    inside the watermark count once. Partial sessions are merged before the
    shuffle, so a hot source sends session summaries, not signals.
    """
    gap = f"{window_us + 1} microseconds"
    return (
        signals.withWatermark("timestamp", watermark)
        .dropDuplicatesWithinWatermark(["id"])
        .groupBy(*SESSION_KEYS, F.session_window("timestamp", gap).alias("w"))
        .agg(
            F.min(F.unix_micros("timestamp")).alias("session_start"),
            F.max(F.unix_micros("timestamp")).alias("session_end"),
            F.count(F.lit(1)).alias("signal_count"),
            max_severity(F.col("severity")).alias("max_severity"),
        )
        .drop("w")
    )


def unsessioned_signals(stored: DataFrame, sessions: DataFrame, window_us: int = DEFAULT_WINDOW_US) -> DataFrame:
    """Stored signals no emitted session covers: they came after the watermark.

    Sessions are spread over the time cells they cover, which makes the interval
    test an equality join on (source, env, cell).
    """
    width = F.lit(max(window_us, 1)).cast("long")
    spans = sessions.select(
        *SESSION_KEYS,
        "session_start",
        "session_end",
        F.explode(
            F.sequence(cell_of(F.col("session_start"), window_us), cell_of(F.col("session_end"), window_us), width)
        ).alias("cell"),
    )
    at = F.unix_micros("timestamp")
    timed = stored.withColumn("_at", at).withColumn("cell", cell_of(at, window_us))
    covered = [timed[k] == spans[k] for k in (*SESSION_KEYS, "cell")]
    covered.append(timed["_at"].between(spans["session_start"], spans["session_end"]))
    return timed.join(spans, covered, "left_anti").drop("_at", "cell")


def repaired_sessions(stored: DataFrame, sessions: DataFrame, window_us: int = DEFAULT_WINDOW_US) -> DataFrame:
    """Batch sessions of every (source, env) that has an uncovered signal."""
    late = unsessioned_signals(stored, sessions, window_us).select(*SESSION_KEYS).distinct()
    return session_summary(stored.join(late, list(SESSION_KEYS), "left_semi"), window_us)


@dataclass
class Repair:
    retracted: DataFrame  # sessions as they were emitted
    repaired: DataFrame  # what takes their place


def _days(first, last):
    return F.explode(F.sequence(cell_of(first, DAY_US), cell_of(last, DAY_US), F.lit(DAY_US).cast("long"))).alias("day")


def repair_sessions(late: DataFrame, sessions: DataFrame, window_us: int = DEFAULT_WINDOW_US) -> Repair:
    """What late signals change in emitted ``sessions``, without a look at the signals these were made of.

    Emitted sessions lie more than the window apart, so only late signals between
    them can join them. Late signals are put together to sessions of their own;
    these and the emitted sessions of the days they may reach are intervals, which
    join where the pause is at most the window. A session that no late signal
    reaches is neither retracted nor returned. ``late`` holds signals no emitted
    session covers, for instance the ones of an epoch that :func:`unsessioned_signals`
    names; other days and other keys are not read beyond the bounds of their sessions.
    """
    columns = ["session_start", "session_end", "signal_count", "max_severity"]
    fresh = checkpointed(session_summary(late, window_us).select(*SESSION_KEYS, *columns))
    reach = _days(F.col("session_start") - window_us, F.col("session_end") + window_us)
    wanted = broadcast_if_small(fresh.select(*SESSION_KEYS, reach).distinct(), materialize=True)
    spread = sessions.select(*SESSION_KEYS, *columns, _days(F.col("session_start"), F.col("session_end")))
    near = spread.join(wanted, [*SESSION_KEYS, "day"], "left_semi").drop("day").distinct()
    both = near.withColumn("emitted", F.lit(True)).unionByName(fresh.withColumn("emitted", F.lit(False)))
    # Only sessions of days with late signals are here: a key has few of them.
    in_order = Window.partitionBy(*SESSION_KEYS).orderBy("session_start", "session_end")
    before = F.max("session_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.when(before.isNull() | (F.col("session_start") - before > window_us), F.col("session_start"))
    joined = both.withColumn("_begun", begun).withColumn("whole_start", F.max("_begun").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = checkpointed(joined.drop("_begun"))
    whole = joined.groupBy(*SESSION_KEYS, "whole_start").agg(
        F.max("session_end").alias("_end"),
        F.sum("signal_count").alias("signal_count"),
        F.max("max_severity").alias("max_severity"),
        F.bool_or(~F.col("emitted")).alias("_changed"),
    )
    changed = whole.where("_changed")
    retracted = joined.where("emitted").join(changed.select(*SESSION_KEYS, "whole_start"), [*SESSION_KEYS, "whole_start"], "left_semi")
    repaired = changed.select(*SESSION_KEYS, F.col("whole_start").alias("session_start"), F.col("_end").alias("session_end"), "signal_count", "max_severity")
    return Repair(retracted.select(*SESSION_KEYS, *columns), repaired)
