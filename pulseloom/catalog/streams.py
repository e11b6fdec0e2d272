"""Structured Streaming queries: each runs its stream to the end of the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulseloom.catalog.analysis import tables_of
from pulseloom.catalog.base import ANALYZED, AS_OF_US, CANDIDATES, FLAGGED, HOUR, MINUTE, RULES, SIGNALS, as_of, query, sessions_sql, sql_mask
from pulseloom.catalog.incidents import BASE, CLAIMS, stored_incidents
from pulseloom.catalog.incidents import sessions as hour_sessions
from pulseloom.catalog.signals import validated
from pulseloom.operators.ingest import classified_signals
from pulseloom.operators.sessions import session_summary
from pulseloom.session import checkpointed, scratch_folder
from pulseloom.sources.signal_store import SignalStore
from pulseloom.sources.tables import event_stream, raw_signals_of, signals, signals_of, table
from pulseloom.streaming.claims import EVENTS, opened_events, session_events, stream_claims
from pulseloom.streaming.ingest import ingest_epoch, stream_incidents, stream_ingest
from pulseloom.streaming.metrics import read_counts, rolling_counts, stream_counts
from pulseloom.streaming.sessions import repair_sessions, repaired_sessions, stream_sessions, unsessioned_signals

_LATENESS_US = 10 * MINUTE

# What the stream accepts: as the batch form, but the missing times are the
# moment of arrival, so only rows with a time are compared.
_ACCEPTED = f"""{FLAGGED}, accepted as (select f.*, r.ts_text from flagged f join raw r using (batch_id, pos) where not is_duplicate)"""


def _run_ingest(spark, sf_dir) -> str:
    base = scratch_folder(spark)
    stream_ingest(raw_signals_of(event_stream(spark, sf_dir)), base, f"{base}/checkpoint").awaitTermination()
    return base


@query(
    "stream_ingest",
    f"with {_ACCEPTED} select id, event_type, source, env, severity, {sql_mask('message')} as message from accepted",
)
def stream_ingest_query(spark, sf_dir):
    base = _run_ingest(spark, sf_dir)
    return SignalStore(spark, f"{base}/signals").read().select("id", "event_type", "source", "env", "severity", "message")


@query(
    "stream_ingest_batches",
    f"""with {_ACCEPTED} select id, event_type, source, env, case when ts_text is not null then ts_us end as ts_us, severity,
      {sql_mask('message')} as message, payload from accepted""",
)
def stream_ingest_batches(spark, sf_dir):
    """Three micro-batches of whole batches; each of the later ones also sends a third of the first again."""
    base = scratch_folder(spark)
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id").alias("n")).first()["n"]
    third = (last // 300 + 1) * 100
    for number in range(3):
        again = (F.col("event_id") < third) & (F.floor(F.col("event_id") / 100) % 3 == number)
        part = events.where((F.floor(F.col("event_id") / third) == number) | again)
        part.write.mode("append").parquet(f"{base}/feed")
        # All new files are one micro-batch, so a batch is written and read by many tasks.
        feed = spark.readStream.schema(events.schema).parquet(f"{base}/feed")
        stream_ingest(raw_signals_of(feed), base, f"{base}/checkpoint").awaitTermination()
    # Missing times became the moment of arrival.
    at = F.when(F.col("timestamp") < F.lit("2025-01-01").cast("timestamp"), F.unix_micros("timestamp"))
    return SignalStore(spark, f"{base}/signals").read().select("id", "event_type", "source", "env", at.alias("ts_us"), "severity", "message", "payload")


@query(
    "expire_signals",
    f"""with {SIGNALS} select id, env, ts_us, severity, message, payload from signals
      where ts_us >= {AS_OF_US} - 86400000000 * case env when 'production' then 30 when 'staging' then 14 else 7 end""",
)
def expire_signals(spark, sf_dir):
    """A store of two epochs, compacted and expired; what is left."""
    store = SignalStore(spark, f"{scratch_folder(spark)}/signals")
    rows = signals(spark, sf_dir)
    for epoch, part in enumerate((rows.where("severity < 3"), rows.where("severity >= 3"))):
        store.append(part, epoch)
    store.compact()
    store.expire(as_of())
    return store.read().select("id", "env", F.unix_micros("timestamp").alias("ts_us"), "severity", "message", "payload")


@query(
    "stored_ids",
    f"""with {SIGNALS} select id from signals where cast(substr(id, 5) as bigint) % 2 = 0
      and id in (select 'evt-' || o_custkey from orders)""",
)
def stored_ids(spark, sf_dir):
    """Ids of another table against the index of a store that has every second signal."""
    store = SignalStore(spark, f"{scratch_folder(spark)}/signals")
    store.append(signals(spark, sf_dir).where("cast(substr(id, 5) as bigint) % 2 = 0"), 0)
    return store.known_ids(table(spark, sf_dir, "orders").select(F.concat(F.lit("evt-"), F.col("o_custkey").cast("string")).alias("id")))


@query(
    "ingestion_metrics",
    f"""with {FLAGGED} select count(*) filter (not is_duplicate) as accepted_count, count(*) filter (is_duplicate) as duplicate_count,
      (select count(*) from validated where len(errors) > 0) as rejected_count from flagged""",
)
def ingestion_metrics(spark, sf_dir):
    base = _run_ingest(spark, sf_dir)
    counts = rolling_counts(spark.read.parquet(f"{base}/metrics"), "36500 days")
    return counts.drop("window_start")


# Minutes after AS_OF at which the thirds of the batches arrive: the last one is late.
_ARRIVALS = (10, 80, 50)


@query(
    "live_counters",
    f"""with {FLAGGED}, outcome as (
      select batch_id, case when is_duplicate then 'd' else 'a' end as o from flagged
      union all select batch_id, 'r' from validated where len(errors) > 0),
    timed as (select o, {AS_OF_US} + cast({MINUTE} as bigint) * [{', '.join(map(str, _ARRIVALS))}][batch_id // (select max(event_id) // 300 + 1 from events) + 1] as at_us from outcome)
    select cast(at_us // {60 * MINUTE} * {60 * MINUTE} as bigint) as window_us, count(*) filter (o = 'a') as accepted_count,
      count(*) filter (o = 'd') as duplicate_count, count(*) filter (o = 'r') as rejected_count from timed group by 1""",
)
def live_counters(spark, sf_dir):
    """Hourly counters kept by a stream: two epochs, then a restart and a third epoch of an earlier hour, sent twice."""
    base = scratch_folder(spark)
    events = table(spark, sf_dir, "events")
    third = (events.agg(F.max("event_id").alias("n")).first()["n"] // 300 + 1) * 100
    start = dt.datetime.fromtimestamp(AS_OF_US / 1e6, dt.timezone.utc)
    for epoch in (0, 1, 2, 2):
        part = events.where(F.floor(F.col("event_id") / third) == epoch)
        ingest_epoch(raw_signals_of(part), epoch, base, now=start + dt.timedelta(minutes=_ARRIVALS[epoch]))
        if epoch:
            stream_counts(spark, base, f"{base}/counting").awaitTermination()
    return read_counts(spark, base).select(F.unix_micros("window_start").alias("window_us"), "accepted_count", "duplicate_count", "rejected_count")


@query(
    "stream_sessions",
    f"""with {SIGNALS}, {sessions_sql(MINUTE)} select * from sessions where session_end + {MINUTE} + 1
      <= (select floor(max(ts_us) / 1000) * 1000 from signals) - {_LATENESS_US}""",
)
def stream_sessions_query(spark, sf_dir):
    base = scratch_folder(spark)
    sessions = stream_sessions(signals_of(event_stream(spark, sf_dir)))
    (
        sessions.writeStream.format("parquet")
        .option("path", f"{base}/sessions")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{base}/sessions").select(
        "source", "env", "session_start", "session_end", "signal_count", "max_severity"
    )


@query(
    "stream_incidents",
    f"""with {SIGNALS}, {sessions_sql(MINUTE)}, {RULES}, {CANDIDATES}, {ANALYZED}
    select source, env, 'resolved' as status, max_severity as severity, analysis_summary, count(*) as incidents
    from analyzed where max_severity >= 4 group by all""",
)
def stream_incidents_query(spark, sf_dir):
    """All signals are valid here, so every severe session becomes an incident."""
    base = scratch_folder(spark)
    rules, patterns = tables_of(spark)
    raw = signals_of(event_stream(spark, sf_dir)).select(
        F.lit(0).cast("bigint").alias("batch_id"),
        F.substring_index("id", "-", -1).cast("int").alias("pos"),
        "id", "event_type", "source",
        F.col("env").alias("environment"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "severity", "message", "payload", "metadata",
    )
    stream_incidents(raw, base, f"{base}/checkpoint", rules, patterns).awaitTermination()
    incidents = spark.read.parquet(f"{base}/incidents")
    return incidents.groupBy(
        F.element_at("impacted_services", 1).alias("source"), F.element_at("environments", 1).alias("env"),
        "status", "severity", "analysis_summary",
    ).agg(F.count(F.lit(1)).alias("incidents"))


@query(
    "incident_state",
    f"""with {BASE}, {CLAIMS} select source, env, s.session_start, s.session_end, c.incident_id,
      case when c.incident_id is not null then 'merged' when s.max_severity >= 4 then 'created' else 'dropped' end as outcome
    from sessions s left join claims c using (source, env, session_start)""",
)
def incident_state(spark, sf_dir):
    """Open incidents as streaming state: three micro-batches of sessions in time order, with a restart after the first."""
    base = scratch_folder(spark)
    sessions = checkpointed(hour_sessions(spark, sf_dir))
    events = session_events(sessions)
    first, last = sessions.agg(F.min("session_start"), F.max("session_start")).first()
    third = F.floor((F.col("first_us") - F.lit(first)) * 3 / F.lit(last - first + 1))
    known = opened_events(stored_incidents(spark, sf_dir), F.timestamp_micros(F.lit(first)))
    for number in range(3):
        part = events.where(third == number)
        (known.unionByName(part) if number == 0 else part).coalesce(1).write.mode("append").parquet(f"{base}/feed")
        if number != 1:
            feed = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
            stream_claims(feed, f"{base}/decisions", f"{base}/checkpoint", HOUR, watermark="60 days").awaitTermination()
    return spark.read.parquet(f"{base}/decisions").drop("epoch")


_LATE = f"""{SIGNALS}, early as (select * from signals where severity < 5), {sessions_sql(MINUTE, 'early')}"""


def _emitted(spark, sf_dir):
    """Sessions as if every severity 5 signal had come too late."""
    return session_summary(signals(spark, sf_dir).filter("severity < 5"), MINUTE)


@query(
    "unsessioned_signals",
    f"""with {_LATE} select id from signals s where not exists (select 1 from sessions e where e.source = s.source and e.env = s.env
      and s.ts_us between e.session_start and e.session_end)""",
)
def unsessioned(spark, sf_dir):
    return unsessioned_signals(signals(spark, sf_dir), _emitted(spark, sf_dir), MINUTE).select("id")


@query("repaired_sessions", f"with {SIGNALS}, {sessions_sql(MINUTE)} select * from sessions")
def repaired(spark, sf_dir):
    """Late signals touch every source here, so the repair yields the whole batch result."""
    return repaired_sessions(signals(spark, sf_dir), _emitted(spark, sf_dir), MINUTE)


@query(
    "repair_sessions",
    f"""with {_LATE},
    missed as (select s.* from signals s where s.severity >= 5 and not exists (select 1 from sessions e
      where e.source = s.source and e.env = s.env and s.ts_us between e.session_start and e.session_end)),
    whole as (select source, env, ts_us, ts_us as until_us, 1 as n, severity from missed union all
      select source, env, session_start, session_end, signal_count, max_severity from sessions),
    cut as (select *, case when ts_us - max(until_us) over (partition by source, env order by ts_us, until_us rows between unbounded preceding and 1 preceding)
      <= {MINUTE} then null else ts_us end as st from whole),
    placed as (select *, max(st) over (partition by source, env order by ts_us, until_us rows unbounded preceding) as start_us from cut)
    select source, env, start_us as session_start, max(until_us) as session_end, cast(sum(n) as bigint) as signal_count,
      cast(max(severity) as integer) as max_severity from placed group by 1, 2, 3""",
)
def repair_sessions_query(spark, sf_dir):
    """Emitted sessions without the retracted ones, and what takes their place."""
    emitted = checkpointed(_emitted(spark, sf_dir))
    missed = unsessioned_signals(signals(spark, sf_dir), emitted, MINUTE)
    repair = repair_sessions(missed, emitted, MINUTE)
    kept = emitted.join(repair.retracted, ["source", "env", "session_start"], "left_anti")
    return kept.unionByName(repair.repaired).select("source", "env", "session_start", "session_end", "signal_count", "max_severity")


@query(
    "classified_signals",
    f"""with {FLAGGED} select batch_id, pos, case when is_duplicate then 'duplicate' else 'accepted' end as outcome from flagged
      union all select batch_id, pos, 'rejected' from validated where len(errors) > 0""",
)
def classified(spark, sf_dir):
    return classified_signals(validated(spark, sf_dir))
