"""Open incidents as the state of a stream: each (source, env) knows its own.

One stream carries what happens to incidents (opened, closed) and the closed
sessions, as rows of one narrow shape. The state of a key is a map of its open
incidents, so a micro-batch reads neither the incident table nor other keys, and
the state leaves with the watermark: an incident that no session to come can reach
is forgotten by an event-time timer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pulseloom.operators.incidents import create_incidents, merge_incidents, open_incidents, open_places
from pulseloom.operators.sessions import DEFAULT_WINDOW_US, SESSION_KEYS, is_high

OPENED, CLOSED, SESSION = "opened", "closed", "session"
MERGED, CREATED, DROPPED = "merged", "created", "dropped"
EVENTS = "kind string, source string, env string, at timestamp, incident_id string, first_us long, last_us long, high boolean"
DECISIONS = "source string, env string, session_start long, session_end long, outcome string, incident_id string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def opened_events(incidents: DataFrame, at: Column) -> DataFrame:
    """Events of the open ones among ``incidents``, as they are known since ``at``.

    An incident has to touch one source and one environment, as those do that
    sessions create. One that touches several ties keys together, whose states
    know nothing of each other: it raises an error here and needs ``correlate``.
    """
    several = (F.size(F.array_distinct("impacted_services")) > 1) | (F.size(F.array_distinct("environments")) > 1)
    refused = F.raise_error(F.concat(F.lit("open incident touches several keys: "), F.col("id")))
    alone = open_incidents(incidents).withColumn("id", F.when(several, refused).otherwise(F.col("id")))
    places = open_places(alone).withColumn("at", at)
    return places.select(
        F.lit(OPENED).alias("kind"), *SESSION_KEYS, "at", "incident_id",
        F.col("updated_us").alias("first_us"), F.col("updated_us").alias("last_us"), F.lit(False).alias("high"),
    )


def closed_events(incidents: DataFrame, at: Column) -> DataFrame:
    """Events of ``incidents`` (id, impacted_services, environments) that are closed since ``at``."""
    zero = F.lit(0).cast("long")
    placed = incidents.withColumn("source", F.explode("impacted_services")).withColumn("env", F.explode("environments")).withColumn("at", at)
    return placed.select(
        F.lit(CLOSED).alias("kind"), *SESSION_KEYS, "at", F.col("id").alias("incident_id"),
        zero.alias("first_us"), zero.alias("last_us"), F.lit(False).alias("high"),
    )


def session_events(sessions: DataFrame) -> DataFrame:
    """Events of closed sessions (source, env, session_start, session_end, max_severity), at their ends."""
    return sessions.select(
        F.lit(SESSION).alias("kind"), *SESSION_KEYS, F.timestamp_micros("session_end").alias("at"), F.lit("").alias("incident_id"),
        F.col("session_start").alias("first_us"), F.col("session_end").alias("last_us"), is_high(F.col("max_severity")).alias("high"),
    )


class OpenIncidents(StatefulProcessor):
    """Claims of one key. In a micro-batch incidents come first, in the order of ``at``, then sessions by their start."""

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "incident_id string", "updated_us long")

    def _held(self, watermark_ms: int) -> dict[str, int]:
        """Open incidents by id, without those that ended a window before the watermark; these leave the state."""
        held = {k[0]: v[0] for k, v in self.open.iterator()} if self.open.exists() else {}
        for id_ in [i for i, updated in held.items() if updated + self.window_us < watermark_ms * 1000]:
            self.open.removeKey((id_,))
            del held[id_]
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows), ignore_index=True)  # one key's narrow rows of one micro-batch
        before = self._held(timerValues.getCurrentWatermarkInMs())
        held = dict(before)
        changes = batch[batch["kind"] != SESSION].sort_values(["at", "kind", "first_us"], kind="stable")
        for kind, id_, updated in zip(changes["kind"], changes["incident_id"], changes["first_us"], strict=True):
            if kind == OPENED:
                held[id_] = int(updated)
            else:
                held.pop(id_, None)
        offers = sorted((updated, id_) for id_, updated in held.items())
        sessions = batch[batch["kind"] == SESSION].sort_values(["first_us", "last_us"], kind="stable")
        out = []
        for first, last, high in zip(sessions["first_us"], sessions["last_us"], sessions["high"], strict=True):
            place = bisect_left(offers, (int(last) - self.window_us, ""))
            if place < len(offers):
                id_ = offers.pop(place)[1]
                del held[id_]
                out.append((*key, int(first), int(last), MERGED, id_))
            else:
                out.append((*key, int(first), int(last), CREATED if high else DROPPED, None))
        for id_ in before.keys() - held.keys():
            self.open.removeKey((id_,))
        fresh = [id_ for id_, updated in held.items() if before.get(id_) != updated]
        for id_ in fresh:
            self.open.updateValue((id_,), (held[id_],))
        if fresh:  # one timer behind the last of them; earlier ones leave when the key is met again
            self.handle.registerTimer((max(held[i] for i in fresh) + self.window_us) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["source", "env", "session_start", "session_end", "outcome", "incident_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self._held(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def claim_stream(events: DataFrame, window_us: int = DEFAULT_WINDOW_US, watermark: str = "1 day") -> DataFrame:
    """What becomes of every session of a stream of ``events``: merged into an incident, created as one, or dropped.

    The claims are those of ``claim_incidents`` run on each micro-batch with the
    incidents open then. A claimed incident is resolved and leaves the state until
    an event opens it again. Sessions have to come once each, as ``stream_sessions`` emits them.
    Rows older than the watermark are not decided; :func:`undecided_sessions` finds them.
    """
    return (
        events.withWatermark("at", watermark)
        .groupBy(*SESSION_KEYS)
        .transformWithStateInPandas(OpenIncidents(window_us), DECISIONS, "Append", "EventTime")
    )


def stream_claims(
    events: DataFrame, path: str, checkpoint: str, window_us: int = DEFAULT_WINDOW_US, watermark: str = "1 day", **trigger: object
) -> StreamingQuery:
    """Write the decisions of :func:`claim_stream` below ``path``, by epoch; an epoch that runs again replaces its own.

    State of this kind needs the RocksDB store, which is set for this query only.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"

    def keep(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("epoch", F.lit(epoch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    writer = claim_stream(events, window_us, watermark).writeStream.outputMode("append").foreachBatch(keep)
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(name, before)


def undecided_sessions(sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions that came after the watermark: no decision names them."""
    return sessions.join(decisions.select(*SESSION_KEYS, "session_start"), [*SESSION_KEYS, "session_start"], "left_anti")


def decided_changes(analyzed: DataFrame, decisions: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """The incidents to upsert: those that ``decisions`` merge into and those they create, from the sessions' analysis."""
    session = [*SESSION_KEYS, "session_start"]
    claims = decisions.where(F.col("outcome") == MERGED).select(*session, "incident_id")
    fresh = analyzed.join(decisions.where(F.col("outcome") == CREATED).select(*session), session, "left_semi")
    return merge_incidents(analyzed, claims, incidents, as_of).unionByName(create_incidents(fresh, as_of))
