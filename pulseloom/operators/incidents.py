"""Incidents: creation, relation to open ones, merging, upsert and status.

A session is related to the open incident of its source and environment with
the smallest (updated_at, id) among those with updated_at >= end - window.
Both forms below are ordered merges on that axis, cut into time buckets: the
local part runs per (source, env, bucket), and only bucket summaries meet in a
window per key. A key with many incidents or sessions is therefore split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.analysis import append_recommendations, is_open
from pulseloom.operators.changes import last_request
from pulseloom.operators.groups import connected
from pulseloom.operators.sessions import DEFAULT_WINDOW_US, SESSION_KEYS, cell_of, is_high
from pulseloom.session import broadcast_if_small, checkpointed

BUCKET_US = 86_400_000_000
TITLE = "Auto-generated incident"
RESOLVED = "resolved"


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter(is_open(F.col("status")))


def incident_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def open_places(incidents: DataFrame) -> DataFrame:
    """Open incidents per (source, env) they touch: incident_id, source, env, updated_us."""
    return (
        open_incidents(incidents)
        .filter(F.col("updated_at").isNotNull())
        .select(F.col("id").alias("incident_id"), "impacted_services", "environments", F.unix_micros("updated_at").alias("updated_us"))
        .withColumn("source", F.explode(F.array_distinct("impacted_services")))
        .withColumn("env", F.explode(F.array_distinct("environments")))
        .drop("impacted_services", "environments")
    )


def related_incident(
    sessions: DataFrame,
    incidents: DataFrame,
    window_us: int = DEFAULT_WINDOW_US,
    two_sided: bool = False,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """Sessions (source, env, session_start, session_end) with their first related
    incident, each session looked at on its own. Null when there is none.

    ``two_sided`` also asks that the incident was not updated after the session.
    """
    keys = list(SESSION_KEYS)
    # One candidate per instant is enough, so repeats go before the shuffle.
    places = (
        open_places(incidents)
        .groupBy(*keys, F.col("updated_us").alias("at"))
        .agg(F.min("incident_id").alias("incident_id"))
        .withColumn("bucket", cell_of(F.col("at"), bucket_us))
    )
    wanted = sessions.withColumn("at", F.col("session_end") - F.lit(int(window_us))).withColumn(
        "bucket", cell_of(F.col("at"), bucket_us)
    )
    candidate = F.struct(F.col("at").alias("updated_us"), "incident_id")
    events = wanted.withColumn("candidate", F.lit(None).cast("struct<updated_us:bigint,incident_id:string>")).unionByName(
        places.select(*keys, "at", "bucket", candidate.alias("candidate")), allowMissingColumns=True
    )
    # Downwards in time an incident at the wanted instant comes before the session.
    local = Window.partitionBy(*keys, "bucket").orderBy(F.desc("at"), F.col("candidate").isNull())
    found = events.withColumn(
        "_local", F.last("candidate", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("candidate").isNull())

    heads = places.groupBy(*keys, "bucket").agg(F.min(candidate).alias("_head"))
    asked = wanted.select(*keys, "bucket").distinct().withColumn("_asked", F.lit(True))
    downwards = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        heads.join(asked, [*keys, "bucket"], "full")
        .withColumn("_next", F.last("_head", ignorenulls=True).over(downwards))
        .filter("_asked")
        .select(*keys, "bucket", "_next")
    )
    best = F.coalesce(F.col("_local"), F.col("_next"))
    if two_sided:
        best = F.when(best["updated_us"] <= F.col("session_end"), best)
    return (
        found.join(carried, [*keys, "bucket"], "left")
        .withColumn("incident_id", best["incident_id"])
        .select(*sessions.columns, "incident_id")
    )


def _claims(sessions: DataFrame, places: DataFrame, window_us: int, bucket_us: int) -> DataFrame:
    """Greedy claims in session order, every incident taken at most once per key.

    Session i asks for incidents from rank low(i) on, the count of incidents
    before its instant. Sessions ask in growing order, so the incident taken is
    the one of rank i + max(low(j) - j for j <= i): two running sums and one
    running maximum, no loop.
    """
    keys = list(SESSION_KEYS)
    asks = sessions.select(
        *keys,
        (F.col("session_end") - F.lit(int(window_us))).alias("at"),
        F.lit(0).alias("side"),
        F.col("session_start"),
        F.lit(None).cast("string").alias("incident_id"),
    )
    offers = places.select(
        *keys,
        F.col("updated_us").alias("at"),
        F.lit(1).alias("side"),
        F.lit(None).cast("long").alias("session_start"),
        "incident_id",
    )
    events = asks.unionByName(offers).withColumn("bucket", cell_of(F.col("at"), bucket_us))
    bucket = [*keys, "bucket"]
    in_bucket = Window.partitionBy(*bucket).orderBy("at", "side", "session_start", "incident_id")
    before = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = events.withColumn("_offers", F.coalesce(F.sum("side").over(before), zero)).withColumn(
        "_asks", F.coalesce(F.sum(1 - F.col("side")).over(before), zero)
    )
    over_buckets = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Per bucket: how many asks and offers, and the largest local low - i.
    lead = F.max(F.when(F.col("side") == 0, F.col("_offers") - F.col("_asks")))
    sums = (
        local.groupBy(*bucket)
        .agg(F.sum("side").alias("_n"), F.sum(1 - F.col("side")).alias("_m"), lead.alias("_lead"))
        .withColumn("_n0", F.coalesce(F.sum("_n").over(over_buckets), zero))
        .withColumn("_m0", F.coalesce(F.sum("_m").over(over_buckets), zero))
        .withColumn("_lead0", F.max(F.col("_lead") + F.col("_n0") - F.col("_m0")).over(over_buckets))
        .select(*bucket, "_n0", "_m0", "_lead0")
    )
    ranked = (
        local.join(sums, bucket)
        .withColumn("_low", F.col("_n0") + F.col("_offers"))
        .withColumn("_i", F.col("_m0") + F.col("_asks"))
    )
    until = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.max(F.when(F.col("side") == 0, F.col("_low") - F.col("_i"))).over(until)
    ranked = ranked.withColumn("_rank", F.when(F.col("side") == 1, F.col("_low")).otherwise(
        F.col("_i") + F.greatest(running, F.col("_lead0"))
    ))
    taken = ranked.filter("side = 0").select(*keys, "session_start", "_rank")
    offered = ranked.filter("side = 1").select(*keys, "incident_id", "_rank")
    return taken.join(offered, [*keys, "_rank"]).drop("_rank")


def dependent_keys(places: DataFrame) -> DataFrame:
    """source, env, part: the keys that share an open incident with another key; keys of one part depend on each other."""
    key = F.to_json(F.struct(*SESSION_KEYS))
    named = places.select("incident_id", *SESSION_KEYS, key.alias("key"))
    several = named.groupBy("incident_id").agg(F.min("key").alias("head"), F.max("key").alias("last")).where("head < last")
    links = named.join(several, "incident_id").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    parts = connected(links).withColumnRenamed("group", "part")
    return named.select(*SESSION_KEYS, "key").distinct().join(parts, F.col("key") == F.col("node")).select(*SESSION_KEYS, "part")


def claim_incidents(
    sessions: DataFrame, incidents: DataFrame, window_us: int = DEFAULT_WINDOW_US, bucket_us: int = BUCKET_US
) -> DataFrame:
    """(source, env, session_start, incident_id): an incident taken by one session
    is resolved and not available to the next one.

    Keys act in (source, env) order. Keys that share no incident with another are
    claimed in one pass. Incidents that touch several keys tie keys into parts;
    inside these, claims are repeated, each key without what smaller keys of its
    part claimed last time, and a part leaves the rounds as soon as nothing in it
    changes. After round r the first r keys of a part are final, so this ends.
    """
    places = open_places(incidents)
    shared = places.groupBy("incident_id").count().filter("count > 1")
    if shared.isEmpty():
        return _claims(sessions, places, window_us, bucket_us)
    keys = list(SESSION_KEYS)
    place = F.struct(*keys)
    places = checkpointed(places)
    tied = broadcast_if_small(dependent_keys(places), materialize=True)
    alone = _claims(sessions.join(tied, keys, "left_anti"), places.join(tied, keys, "left_anti"), window_us, bucket_us)
    asking = checkpointed(sessions.select(*keys, "session_start", "session_end").join(tied, keys))
    offered = places.join(tied, keys)

    def claimed(open_parts: DataFrame | None, free: DataFrame) -> DataFrame:
        wanted = asking if open_parts is None else asking.join(open_parts, "part", "left_semi")
        return checkpointed(_claims(wanted, free, window_us, bucket_us).join(tied, keys))

    settled, claims, open_parts = [alone], claimed(None, offered), None
    while True:
        owners = claims.groupBy("incident_id").agg(F.min(place).alias("_owner"))
        live = offered if open_parts is None else offered.join(open_parts, "part", "left_semi")
        free = live.join(owners, "incident_id", "left").filter(F.col("_owner").isNull() | (place <= F.col("_owner"))).drop("_owner")
        again = claimed(open_parts, free)
        both = claims.withColumn("_n", F.lit(1)).unionByName(again.withColumn("_n", F.lit(-1)))
        moved = both.groupBy(*again.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").select("part").distinct()
        open_parts = broadcast_if_small(moved, materialize=True)
        settled.append(again.join(open_parts, "part", "left_anti").drop("part"))
        if open_parts.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        claims = again.join(open_parts, "part", "left_semi").select(*again.columns)


def session_incident_id(as_of: Column) -> Column:
    """Id of the incident a session creates: the same whenever a job runs again."""
    return incident_id(F.col("source"), F.col("env"), F.col("session_start"), F.unix_micros(as_of))


def create_incidents(analyzed: DataFrame, as_of: Column) -> DataFrame:
    """New incidents from analysed high-severity sessions."""
    return analyzed.filter(is_high(F.col("max_severity"))).select(
        session_incident_id(as_of).alias("id"),
        F.lit(TITLE).alias("title"),
        F.lit(RESOLVED).alias("status"),
        F.col("max_severity").alias("severity"),
        F.array("source").alias("impacted_services"),
        F.array("env").alias("environments"),
        "analysis_summary",
        "recommendations",
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def merge_incidents(analyzed: DataFrame, claims: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """Claimed incidents after the merge: a high-severity session may raise the
    severity, any session replaces the summary and appends its recommendations."""
    found = analyzed.join(claims, [*SESSION_KEYS, "session_start"]).select(
        F.col("incident_id").alias("id"),
        F.col("max_severity").alias("_severity"),
        F.col("analysis_summary").alias("_summary"),
        F.col("recommendations").alias("_advice"),
    )
    raised = F.when(is_high(F.col("_severity")), F.greatest("severity", "_severity")).otherwise(F.col("severity"))
    return incidents.join(found, "id").select(
        "id",
        "title",
        F.lit(RESOLVED).alias("status"),
        raised.alias("severity"),
        "impacted_services",
        "environments",
        F.col("_summary").alias("analysis_summary"),
        append_recommendations(F.col("recommendations"), F.col("_advice")).alias("recommendations"),
        "created_at",
        as_of.alias("updated_at"),
    )


def merge_high(analyzed: DataFrame, claims: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    return merge_incidents(analyzed.filter(is_high(F.col("max_severity"))), claims, incidents, as_of)


def merge_low(analyzed: DataFrame, claims: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """Low-severity sessions only enrich: severity stays, no match is dropped."""
    return merge_incidents(analyzed.filter(~is_high(F.col("max_severity"))), claims, incidents, as_of)


def union_incident_signals(links: DataFrame, extra: DataFrame) -> DataFrame:
    """New link rows (incident_id, signal_id) an incident does not have yet."""
    return extra.dropDuplicates(["incident_id", "signal_id"]).join(
        links.select("incident_id", "signal_id"), ["incident_id", "signal_id"], "left_anti"
    )


def upsert_incidents(existing: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Insert or overwrite everything but ``created_at``; of several rows of one id the last by ``pos`` counts."""
    columns = existing.columns
    named = incoming.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), incident_id(*[F.to_json(F.struct(*columns))])))
    named = last_request(named)
    born = existing.select("id", F.col("created_at").alias("_born"))
    fresh = (
        named.join(born, "id", "left")
        .withColumn("created_at", F.coalesce("_born", "created_at", as_of))
        .withColumn("updated_at", as_of)
        .select(*columns)
    )
    return existing.join(named.select("id"), "id", "left_anti").select(*columns).unionByName(fresh)


def set_status(incidents: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Apply (id, status) updates; blank ids or statuses change nothing, of several for one id the last by ``pos`` counts."""
    valid = updates.filter(status_error(F.col("id"), F.col("status")).isNull())
    usable = last_request(valid).select("id", F.col("status").alias("_status"))
    return (
        incidents.join(usable, "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("updated_at", F.when(F.col("_status").isNotNull(), as_of).otherwise(F.col("updated_at")))
        .select(*incidents.columns)
    )


def status_error(id_: Column, status: Column) -> Column:
    return F.when(F.coalesce(id_, F.lit("")) == "", F.lit("incident id is required")).when(
        F.coalesce(status, F.lit("")) == "", F.lit("incident status is required")
    )


def status_errors(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that failed: a required value is missing, or the id is unknown."""
    checked = updates.withColumn("error", status_error(F.col("id"), F.col("status")))
    unknown = checked.filter("error is null").join(incidents.select("id"), "id", "left_anti")
    return checked.filter("error is not null").unionByName(unknown.withColumn("error", F.lit("not found")))


def lookup(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Bulk lookup by id of signals or incidents."""
    return rows.join(ids.select("id"), "id", "left_semi")


