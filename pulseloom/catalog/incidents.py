"""Incident queries: relation, claims, merges, upsert, status, retention, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom.catalog.base import ANALYSIS_CTES, AS_OF_US, HOUR, SIGNALS, as_of, joined, query, sessions_sql
from pulseloom.catalog.analysis import KEYS, analyzed, tables_of
from pulseloom.functions import analysis as an
from pulseloom.operators import delivery as dl
from pulseloom.operators import incidents as inc
from pulseloom.operators import retention as rt
from pulseloom.operators.sessions import session_members, session_summary
from pulseloom.plans.correlate import correlate
from pulseloom.session import checkpointed
from pulseloom.sources.tables import signals, table

# One stored incident per 1 h session; two in five are open, and their last
# update lies up to two hours before the session.
STATUS = "case session_start % 5 when 0 then 'new' when 1 then 'Open' when 2 then 'resolved' when 3 then 'Closed' else 'in-progress' end"
UPDATED = f"session_start - (session_start % 3) * {HOUR}"
STORED = f"""stored as (
  select 'inc-' || source || '-' || env || '-' || session_start as id, source, env, {STATUS} as status, max_severity as severity,
    session_start as created_us, {UPDATED} as updated_us from sessions)"""
OPEN = "open as (select * from stored where lower(status) not in ('resolved', 'closed', 'in-progress'))"
BASE = f"{SIGNALS}, {sessions_sql(HOUR)}, {STORED}, {OPEN}"
FULL = f"{ANALYSIS_CTES}, {STORED}, {OPEN}"

CLAIMS = f"""axis as (
  select source, env, session_end - {HOUR} as moment, 0 as side, session_start, null as id from sessions
  union all select source, env, updated_us, 1, null, id from open),
counted as (
  select *, coalesce(sum(side) over w, 0) as low, coalesce(sum(1 - side) over w, 0) as i from axis
  window w as (partition by source, env order by moment, side, session_start, id rows between unbounded preceding and 1 preceding)),
ranked as (
  select *, case side when 1 then low else i + max(case when side = 0 then low - i end) over (
    partition by source, env order by moment, side, session_start, id rows between unbounded preceding and current row) end as rank
  from counted),
claims as (
  select a.source, a.env, a.session_start, o.id as incident_id
  from ranked a join ranked o on a.source = o.source and a.env = o.env and a.rank = o.rank and a.side = 0 and o.side = 1)"""


def sessions(spark, sf_dir):
    return session_summary(signals(spark, sf_dir), HOUR)


def stored_incidents(spark, sf_dir):
    """Written once, as the stored table it stands for."""
    return checkpointed(_incident_rows(sessions(spark, sf_dir)))


def _incident_rows(sessions_):
    return sessions_.selectExpr(
        "concat('inc-', source, '-', env, '-', session_start) as id",
        "'Auto-generated incident' as title",
        f"{STATUS} as status",
        "max_severity as severity",
        "array(source) as impacted_services",
        "array(env) as environments",
        "'earlier summary' as analysis_summary",
        "array('earlier advice') as recommendations",
        "timestamp_micros(session_start) as created_at",
        f"timestamp_micros({UPDATED}) as updated_at",
    )


def flat(incidents):
    return incidents.select(
        "id", "title", "status", "severity",
        F.element_at("impacted_services", 1).alias("source"),
        F.element_at("environments", 1).alias("env"),
        "analysis_summary",
        joined("recommendations").alias("recommendations"),
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
    )


# -- reading ----------------------------------------------------------------


@query(
    "scan_incidents",
    f"""with {BASE} select id, 'Auto-generated incident' as title, status, severity, source, env, 'earlier summary' as analysis_summary,
      'earlier advice' as recommendations, created_us, updated_us from stored""",
)
def scan_incidents(spark, sf_dir):
    return flat(stored_incidents(spark, sf_dir))


@query("open_incidents", f"with {BASE} select id, status from open")
def open_incidents(spark, sf_dir):
    return inc.open_incidents(stored_incidents(spark, sf_dir)).select("id", "status")


@query(
    "lookup_incident",
    f"""with {BASE} select id, status from stored where id in (
      select 'inc-' || source || '-' || env || '-' || ts_us from signals)""",
)
def lookup_incident(spark, sf_dir):
    ids = signals(spark, sf_dir).select(F.concat_ws("-", F.lit("inc"), "source", "env", F.unix_micros("timestamp")).alias("id"))
    return inc.lookup(stored_incidents(spark, sf_dir), ids).select("id", "status")


# -- relation and claims ----------------------------------------------------


def _related_sql(extra: str = "") -> str:
    return f"""with {BASE}, matches as (
      select s.source, s.env, s.session_start, o.id,
        row_number() over (partition by s.source, s.env, s.session_start order by o.updated_us, o.id) as rn,
        o.updated_us, s.session_end
      from sessions s join open o on s.source = o.source and s.env = o.env and s.session_end - o.updated_us <= {HOUR})
    select s.source, s.env, s.session_start, m.id as incident_id from sessions s left join (
      select * from matches where rn = 1 {extra}) m using (source, env, session_start)"""


@query("related_incident", _related_sql())
def related_incident(spark, sf_dir):
    found = inc.related_incident(sessions(spark, sf_dir), stored_incidents(spark, sf_dir), HOUR)
    return found.select(*KEYS, "incident_id")


@query("first_candidate", _related_sql("and updated_us <= session_end"))
def first_candidate(spark, sf_dir):
    """The two-sided form: the incident was not updated after the session either."""
    found = inc.related_incident(sessions(spark, sf_dir), stored_incidents(spark, sf_dir), HOUR, two_sided=True)
    return found.select(*KEYS, "incident_id")


def claims(spark, sf_dir):
    return inc.claim_incidents(sessions(spark, sf_dir), stored_incidents(spark, sf_dir), HOUR)


@query("claim_incidents", f"with {BASE}, {CLAIMS} select * from claims")
def claim_incidents(spark, sf_dir):
    return claims(spark, sf_dir).select(*KEYS, "incident_id")


# Incidents that touch a pair of services and, half of them, two environments: the keys of a pair depend on each other.
_NEXT = "concat('svc-', cast(substr(source, 5) as int) + 1 - 2 * (cast(substr(source, 5) as int) % 2))"
_SHARED = f"""{SIGNALS}, {sessions_sql(4 * HOUR)},
offers as (
  select 'inc-' || source || '-' || env || '-' || session_start as id, [source, {_NEXT}] as services,
    case when session_start % 2 = 0 then [env, 'production'] else [env] end as envs, {UPDATED} as updated_us
  from sessions where session_start % 3 > 0)"""


@query(
    "claim_shared_incidents",
    f"""with recursive {_SHARED},
    turns as (select *, row_number() over (order by source, env, session_start) as n from sessions),
    wanted as (
      select t.n, list(o.id order by o.updated_us, o.id) as ids
      from turns t join offers o on list_contains(o.services, t.source) and list_contains(o.envs, t.env) and t.session_end - o.updated_us <= {4 * HOUR}
      group by t.n),
    walk(n, taken, id) as (
      select 0::bigint, []::varchar[], null::varchar
      union all
      select n, case when id is null then taken else list_append(taken, id) end, id from (
        select w.n + 1 as n, w.taken, list_filter(x.ids, lambda i: not list_contains(w.taken, i))[1] as id
        from walk w left join wanted x on x.n = w.n + 1 where w.n < (select count(*) from turns)))
    select t.source, t.env, t.session_start, w.id as incident_id from walk w join turns t on t.n = w.n where w.id is not null""",
)
def claim_shared_incidents(spark, sf_dir):
    """One session after the other takes its first free incident; the twin walks just so."""
    rows = session_summary(signals(spark, sf_dir), 4 * HOUR)
    offers = _incident_rows(rows).withColumn("status", F.lit("new")).where("unix_micros(created_at) % 3 > 0")
    source, env = F.col("impacted_services")[0], F.col("environments")[0]
    number = F.substring(source, 5, 9).cast("int")
    following = F.concat(F.lit("svc-"), number + 1 - 2 * (number % 2))
    wide = F.when(F.unix_micros("created_at") % 2 == 0, F.array(env, F.lit("production"))).otherwise(F.array(env))
    offers = checkpointed(offers.withColumn("environments", wide).withColumn("impacted_services", F.array(source, following)))
    return inc.claim_incidents(rows, offers, 4 * HOUR).select(*KEYS, "incident_id")


# -- creation and merging ---------------------------------------------------

_CREATED = f"""select sha256(source || '|' || env || '|' || session_start || '|{AS_OF_US}') as id, 'Auto-generated incident' as title,
  'resolved' as status, max_severity as severity, source, env, analysis_summary, recommendations,
  cast({AS_OF_US} as bigint) as created_us, cast({AS_OF_US} as bigint) as updated_us
  from analyzed"""


def _merged_sql(condition: str) -> str:
    return f"""select o.id, 'Auto-generated incident' as title, 'resolved' as status,
      case when a.max_severity >= 4 then greatest(o.severity, a.max_severity) else o.severity end as severity,
      o.source, o.env, a.analysis_summary, 'earlier advice|' || a.recommendations as recommendations, o.created_us,
      cast({AS_OF_US} as bigint) as updated_us
    from analyzed a join claims c using (source, env, session_start) join open o on o.id = c.incident_id where {condition}"""


@query("create_incident", f"with {FULL} {_CREATED} where max_severity >= 4")
def create_incident(spark, sf_dir):
    return flat(inc.create_incidents(analyzed(spark, sf_dir), as_of()))


@query("merge_high", f"with {FULL}, {CLAIMS} {_merged_sql('a.max_severity >= 4')}")
def merge_high(spark, sf_dir):
    stored = stored_incidents(spark, sf_dir)
    taken = inc.claim_incidents(sessions(spark, sf_dir), stored, HOUR)
    return flat(inc.merge_high(analyzed(spark, sf_dir), taken, stored, as_of()))


@query("merge_low", f"with {FULL}, {CLAIMS} {_merged_sql('a.max_severity < 4')}")
def merge_low(spark, sf_dir):
    stored = stored_incidents(spark, sf_dir)
    taken = inc.claim_incidents(sessions(spark, sf_dir), stored, HOUR)
    return flat(inc.merge_low(analyzed(spark, sf_dir), taken, stored, as_of()))


def _correlated(spark, sf_dir, stored=None):
    rules, patterns = tables_of(spark)
    stored = stored_incidents(spark, sf_dir) if stored is None else stored
    return correlate(signals(spark, sf_dir), stored, rules, patterns, as_of(), HOUR)


_CHANGES = f"""changes as ({_merged_sql('true')}
  union all {_CREATED} where max_severity >= 4 and (source, env, session_start) not in (select source, env, session_start from claims))"""


@query("correlate", f"with {FULL}, {CLAIMS}, {_CHANGES} select * from changes")
def correlate_query(spark, sf_dir):
    return flat(_correlated(spark, sf_dir).changes)


@query(
    "incident_signals",
    f"""with {FULL}, {CLAIMS} select coalesce(c.incident_id, sha256(m.source || '|' || m.env || '|' || m.session_start || '|{AS_OF_US}'))
      as incident_id, m.id as signal_id from members m join sessions s using (source, env, session_start)
      left join claims c using (source, env, session_start) where c.incident_id is not null or s.max_severity >= 4""",
)
def incident_signals(spark, sf_dir):
    return _correlated(spark, sf_dir).links.select("incident_id", "signal_id")


@query(
    "union_signal_links",
    f"""with {BASE}, {CLAIMS} select c.incident_id, m.id as signal_id from members m join claims c using (source, env, session_start)
      where m.severity < 5""",
)
def union_signal_links(spark, sf_dir):
    """Links of the severity 5 signals exist already (each sent twice); the rest is new."""
    links = session_members(signals(spark, sf_dir), HOUR).join(claims(spark, sf_dir), list(KEYS))
    extra = links.select("incident_id", F.col("id").alias("signal_id"), "severity")
    known = extra.filter("severity >= 5").drop("severity")
    return inc.union_incident_signals(known, extra.drop("severity").unionByName(known))


@query(
    "correlate_known_links",
    f"""with {FULL}, {CLAIMS} select c.incident_id, m.id as signal_id from members m join claims c using (source, env, session_start)
      where m.severity < 5 union all
      select sha256(m.source || '|' || m.env || '|' || m.session_start || '|{AS_OF_US}'), m.id
      from members m join sessions s using (source, env, session_start)
      where s.max_severity >= 4 and (m.source, m.env, m.session_start) not in (select source, env, session_start from claims)""",
)
def correlate_known_links(spark, sf_dir):
    """A correlation whose incidents have the links of their severity 5 signals already: only the rest is linked."""
    rules, patterns = tables_of(spark)
    rows, stored = signals(spark, sf_dir), stored_incidents(spark, sf_dir)
    taken = inc.claim_incidents(sessions(spark, sf_dir), stored, HOUR)
    known = session_members(rows, HOUR).where("severity >= 5").join(taken, list(KEYS)).select("incident_id", F.col("id").alias("signal_id"))
    return correlate(rows, stored, rules, patterns, as_of(), HOUR, known_links=known).links.select("incident_id", "signal_id")


def _by_event_type(signals_, rules, patterns, window_us):
    """An analyzer of another kind: it names a session's event types and reads no rule."""
    types = session_members(signals_, window_us).groupBy(*KEYS).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    found = session_summary(signals_, window_us).join(types, list(KEYS))
    return found.select(
        *KEYS, "session_end", "max_severity",
        F.concat(F.lit("seen: "), F.array_join("types", ", ")).alias("analysis_summary"),
        F.transform("types", lambda t: F.concat(F.lit("Look at "), t)).alias("recommendations"),
    )


@query(
    "correlate_with_analyzer",
    f"""with {BASE}, {CLAIMS},
    analyzed as (
      select s.*, 'seen: ' || string_agg(distinct m.event_type, ', ' order by m.event_type) as analysis_summary,
        string_agg(distinct 'Look at ' || m.event_type, '|' order by 'Look at ' || m.event_type) as recommendations
      from sessions s join members m using (source, env, session_start)
      group by s.source, s.env, s.session_start, s.session_end, s.signal_count, s.max_severity),
    {_CHANGES} select * from changes""",
)
def correlate_with_analyzer(spark, sf_dir):
    rules, patterns = tables_of(spark)
    stored = stored_incidents(spark, sf_dir)
    return flat(correlate(signals(spark, sf_dir), stored, rules, patterns, as_of(), HOUR, analyzer=_by_event_type).changes)


@query(
    "upsert_incidents",
    f"""with {FULL}, {CLAIMS}, {_CHANGES} select * from changes union all
      select id, 'Auto-generated incident', status, severity, source, env, 'earlier summary', 'earlier advice', created_us, updated_us
      from stored where id not in (select id from changes)""",
)
def upsert_incidents(spark, sf_dir):
    stored = stored_incidents(spark, sf_dir)
    last = _correlated(spark, sf_dir, stored).changes
    earlier = last.withColumn("severity", F.lit(0)).withColumn("pos", F.lit(0))
    return flat(inc.upsert_incidents(stored, earlier.unionByName(last.withColumn("pos", F.lit(1))), as_of()))


# -- status -----------------------------------------------------------------

_NEW_STATUS = "case session_start % 4 when 0 then 'in-progress' when 1 then 'resolved' when 2 then '' end"


def status_updates(spark, sf_dir):
    """One update per session: a quarter without a status, and ids that were never stored."""
    known = sessions(spark, sf_dir).selectExpr(
        "concat('inc-', source, '-', env, '-', session_start) as id", f"{_NEW_STATUS} as status"
    )
    unknown = table(spark, sf_dir, "supplier").selectExpr(
        "case when s_nationkey < 5 then '' else s_name end as id", "'resolved' as status"
    )
    return known, known.unionByName(unknown)


@query(
    "set_status",
    f"""with {BASE} select id, coalesce(nullif({_NEW_STATUS.replace('session_start', 'created_us')}, ''), status) as status,
      case when nullif({_NEW_STATUS.replace('session_start', 'created_us')}, '') is not null then {AS_OF_US} else updated_us end as updated_us
      from stored""",
)
def set_status(spark, sf_dir):
    """Every incident that changes has an earlier request as well, which the last one overrules."""
    last, _ = status_updates(spark, sf_dir)
    earlier = last.where("status <> ''").select("id", F.lit("overruled").alias("status"))
    updates = last.withColumn("pos", F.lit(1)).unionByName(earlier.withColumn("pos", F.lit(0)))
    return flat(inc.set_status(stored_incidents(spark, sf_dir), updates, as_of())).select("id", "status", "updated_us")


@query(
    "set_status_errors",
    f"""with {BASE} select id, 'incident status is required' as error from stored where created_us % 4 in (2, 3)
      union all select case when s_nationkey < 5 then '' else s_name end,
        case when s_nationkey < 5 then 'incident id is required' else 'not found' end from supplier""",
)
def set_status_errors(spark, sf_dir):
    _, updates = status_updates(spark, sf_dir)
    return inc.status_errors(stored_incidents(spark, sf_dir), updates).select("id", "error")


# -- list functions ---------------------------------------------------------


@query(
    "union_signal_ids",
    """with w as (select doc_id, text, lang, source, string_split(text, ' ') as words from documents)
    select doc_id, text || case when list_contains(words, lang) then '' else ' ' || lang end
      || case when list_contains(words, source) or source = lang then '' else ' ' || source end as ids from w""",
)
def union_signal_ids(spark, sf_dir):
    ids = an.union_signal_ids(F.split("text", " "), F.array("lang", "source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, " ").alias("ids"))


@query(
    "append_recommendations",
    "select p_partkey, p_type || '|' || p_type || '|' || p_name as recommendations from part",
)
def append_recommendations(spark, sf_dir):
    both = an.append_recommendations(F.array("p_type"), F.array("p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", joined(both).alias("recommendations"))


@query(
    "analysis_summary",
    "select p_partkey, p_brand || '; ' || p_type || '; ' || p_name as summary from part",
)
def analysis_summary(spark, sf_dir):
    texts = F.array("p_brand", "p_type", "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", an.analysis_summary(texts).alias("summary"))


@query(
    "analysis_source",
    f"with {ANALYSIS_CTES} select analysis_source, count(*) as sessions from analyzed group by 1",
)
def analysis_source(spark, sf_dir):
    return analyzed(spark, sf_dir).groupBy("analysis_source").agg(F.count(F.lit(1)).alias("sessions"))


# -- retention --------------------------------------------------------------

_RAW_DAYS = "case env when 'production' then 30 when 'staging' then 14 else 7 end"
_INCIDENT_DAYS = "case env when 'production' then 365 when 'staging' then 90 else 30 end"
LATER_US = AS_OF_US + 74 * 24 * HOUR  # 2024-04-15


@query(
    "retention_profile",
    """select o_orderkey, case when k in ('prod', 'production') then 30 when k in ('stage', 'staging') then 14 else 7 end as raw_days,
      case when k in ('prod', 'production') then 365 when k in ('stage', 'staging') then 90 else 30 end as incident_days
    from (select o_orderkey, lower(case o_orderkey % 6 when 0 then 'PROD' when 1 then 'production' when 2 then 'Stage'
      when 3 then 'staging' when 4 then o_orderpriority else '' end) as k from orders)""",
)
def retention_profile(spark, sf_dir):
    env = F.expr(
        """case o_orderkey % 6 when 0 then ' PROD ' when 1 then 'production' when 2 then concat(chr(9), 'Stage')
           when 3 then 'staging' when 4 then o_orderpriority end"""
    )
    profile = an.retention_profile(env)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", profile["raw_days"].alias("raw_days"), profile["incident_days"].alias("incident_days")
    )


@query(
    "retention_signals",
    f"""with {SIGNALS} select id, env, ts_us from signals
      where not ts_us < {AS_OF_US} - {_RAW_DAYS} * cast({24 * HOUR} as bigint)""",
)
def retention_signals(spark, sf_dir):
    kept = rt.keep_signals(signals(spark, sf_dir), rt.signal_cutoff(F.col("env"), as_of()))
    return kept.select("id", "env", F.unix_micros("timestamp").alias("ts_us"))


@query(
    "retention_incidents",
    f"""with {BASE} select id from stored where not updated_us < {LATER_US} - {_INCIDENT_DAYS} * cast({24 * HOUR} as bigint)""",
)
def retention_incidents(spark, sf_dir):
    limit = rt.incident_cutoff(F.element_at("environments", 1), F.timestamp_micros(F.lit(LATER_US)))
    return rt.keep_incidents(stored_incidents(spark, sf_dir), limit).select("id")


@query(
    "affected_counts",
    f"""with {SIGNALS} select count(*) filter (ts_us < {AS_OF_US} - {_RAW_DAYS} * cast({24 * HOUR} as bigint)) as deleted from signals""",
)
def affected_counts(spark, sf_dir):
    limit = rt.signal_cutoff(F.col("env"), as_of())
    return rt.expired_count(signals(spark, sf_dir), rt.signal_expired(limit))


@query(
    "oldest_expired",
    f"""with {SIGNALS} select id, ts_us from signals where ts_us < {AS_OF_US} - {_RAW_DAYS} * cast({24 * HOUR} as bigint)
      order by ts_us, id limit 1000""",
)
def oldest_expired(spark, sf_dir):
    limit = rt.signal_cutoff(F.col("env"), as_of())
    top = rt.oldest_expired(signals(spark, sf_dir), rt.signal_expired(limit), "timestamp", 1000)
    return top.select("id", F.unix_micros("timestamp").alias("ts_us"))


@query(
    "oldest_expired_orders",
    """select o_orderkey as id, epoch_us(o_orderdate) as ts_us from orders where o_orderdate < timestamp '1997-01-01'
      order by o_orderdate, o_orderkey limit 1000""",
)
def oldest_expired_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp")
    )
    limit = F.lit("1997-01-01").cast("timestamp")
    top = rt.oldest_expired(orders, rt.signal_expired(limit), "timestamp", 1000)
    return top.select("id", F.unix_micros("timestamp").alias("ts_us"))


# -- delivery ---------------------------------------------------------------

_STEPS = """(0,1,'deliver',0), (0,1,'ack',1000000),
 (1,1,'deliver',0), (1,1,'nack',1000000), (1,2,'deliver',0), (1,2,'ack',1000000),
 (2,1,'deliver',0), (2,1,'nack',1000000), (2,2,'deliver',0), (2,2,'nack',1000000), (2,3,'deliver',0), (2,3,'nack',1000000),
 (3,1,'deliver',0),
 (4,1,'deliver',0), (4,2,'deliver',0), (4,1,'ack',75000000),
 (5,1,'deliver',0), (5,2,'deliver',0), (5,1,'nack',75000000), (5,2,'ack',20000000)"""
_LAST_US = AS_OF_US - 2 * 24 * HOUR  # some leases are still running, later jobs are not there yet
_DELIVERY = f"""log as (
  select e.event_id as job_id, a.attempt, a.step, epoch_us(ts) + a.attempt * 60000000 + a.off_us as ts_us
  from events e join (values {_STEPS}) a(k, attempt, step, off_us) on e.event_id % 6 = a.k),
seen as (select * from log where ts_us <= {_LAST_US}),
attempts as (
  select s.job_id, s.attempt, bool_or(s.step = 'ack' and n.ts_us is null) as acked, bool_or(s.step = 'nack' and n.ts_us is null) as nacked,
    max(case when s.step = 'deliver' then s.ts_us end) as delivered, max(case when s.step <> 'deliver' and n.ts_us is null then s.ts_us end) as processed
  from seen s left join seen n on n.job_id = s.job_id and n.step = 'deliver' and n.attempt = s.attempt + 1 and n.ts_us <= s.ts_us
  group by 1, 2),
judged_attempts as (
  select *, not acked and (nacked or delivered + 30000000 <= {_LAST_US} or attempt < max(attempt) over (partition by job_id)) as failed
  from attempts),
outcomes as (
  select job_id, max(attempt) as attempts, bool_or(acked) as acked, count(*) filter (failed) as retries,
    arg_max(failed, attempt) as last_failed from judged_attempts group by 1),
final as (
  select o.job_id, case when acked then 'acked' when last_failed and attempts + 1 > 3 then 'dead-letter'
      when last_failed then 'ready' else 'in-flight' end as outcome, attempts, cast(retries as integer) as retries,
    p.last_processed_us
  from outcomes o left join (select job_id, max(processed) as last_processed_us from attempts group by 1) p
    using (job_id))"""


def outcomes(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 6 as k", "unix_micros(cast(ts as timestamp)) as us")
    steps = spark.sql(f"select * from values {_STEPS} as a(k, attempt, step, off_us)")
    log = events.join(steps, "k").selectExpr("event_id as job_id", "attempt", "step", "us + attempt * 60000000 + off_us as ts_us")
    return dl.delivery_outcomes(log, F.lit(_LAST_US))


@query("delivery_outcomes", f"with {_DELIVERY} select * from final")
def delivery_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir)


_STATS = """count(*) filter (outcome in ('ready', 'in-flight')) as queue_depth, cast(sum(retries) as bigint) as retry_count,
  count(*) filter (outcome = 'dead-letter') as dead_letter_count, max(last_processed_us) as last_processed_us"""


@query("delivery_stats", f"with {_DELIVERY} select {_STATS} from final")
def delivery_stats(spark, sf_dir):
    return dl.delivery_stats(outcomes(spark, sf_dir))


@query(
    "health_snapshot",
    f"with {BASE}, {_DELIVERY} select {_STATS}, (select count(*) from stored) as incidents from final",
)
def health_snapshot(spark, sf_dir):
    return dl.health_snapshot(outcomes(spark, sf_dir), stored_incidents(spark, sf_dir))
