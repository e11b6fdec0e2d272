"""Registry of named queries with their SQL twins, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.analysis import FALLBACK_RECOMMENDATIONS
from pulseloom.functions.text import WHITE_SPACE
from pulseloom.sources.tables import EVENT_TYPE, MESSAGE, PATTERN_ROWS, RULE_ROWS, SEVERITY

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF_US = 1_706_745_600_000_000  # 2024-02-01T00:00:00Z
MINUTE = 60_000_000
HOUR = 3_600_000_000


def as_of() -> Column:
    return F.timestamp_micros(F.lit(AS_OF_US))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# -- DuckDB pieces ----------------------------------------------------------

WS = "'" + WHITE_SPACE + "'"


def sql_strip(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {WS})"


def sql_environment(expr: str) -> str:
    key = f"lower({sql_strip(expr)})"
    return f"""case when {key} in ('prod', 'production') then 'production' when {key} in ('staging', 'stage') then 'staging'
      when {key} in ('dev', 'development') then 'development' else {key} end"""


SIGNALS = f"""signals as (
  select 'evt-' || event_id as id, {EVENT_TYPE} as event_type, 'svc-' || (user_id % 5) as source,
    case event_id % 3 when 0 then 'production' when 1 then 'staging' else 'development' end as env,
    epoch_us(ts) as ts_us, cast({SEVERITY} as integer) as severity, {MESSAGE} as message, props as payload
  from events)"""


def sessions_sql(gap_us: int, source: str = "signals") -> str:
    """CTEs members (signals with session_start) and sessions."""
    return f"""marked as (
  select *, case when lag(ts_us) over w is null or ts_us - lag(ts_us) over w > {gap_us} then ts_us end as st
  from {source} window w as (partition by source, env order by ts_us, id)),
members as (
  select * exclude (st), max(st) over (partition by source, env order by ts_us, id rows unbounded preceding) as session_start
  from marked),
sessions as (
  select source, env, session_start, max(ts_us) as session_end, count(*) as signal_count,
    cast(greatest(0, max(severity)) as integer) as max_severity
  from members group by 1, 2, 3)"""


RAW = f"""raw as (
  select cast(floor(event_id / 100) as bigint) as batch_id, cast(event_id % 100 as integer) as pos,
    'evt-' || (case when event_id % 29 = 0 and event_id > 0 then event_id - 1 else event_id end) as id,
    case when event_id % 11 = 0 then 'oops' when event_id % 13 = 0 then '' else {EVENT_TYPE} end as event_type,
    case when event_id % 31 = 0 then '' else 'svc-' || (user_id % 5) end as source,
    case event_id % 5 when 0 then ' PROD ' when 1 then 'stage' when 2 then 'Development'
      when 3 then 'production' else 'qa' end as environment,
    case when event_id % 23 = 0 then 'not-a-time' when event_id % 37 = 0 then null
      else strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') end as ts_text, ts,
    case when event_id % 17 = 0 then 9 when event_id % 19 = 0 then null else cast({SEVERITY} as integer) end as severity,
    {MESSAGE} as message, props as payload
  from events)"""

VALIDATED = f"""{RAW},
validated as (
  select batch_id, pos, id, event_type, source, {sql_environment('environment')} as env,
    case when ts_text is null then {AS_OF_US} when ts_text = 'not-a-time' then null else epoch_us(ts) end as ts_us,
    severity, message, payload,
    list_filter([
      case when event_type = '' then 'missing eventType' end,
      case when source = '' then 'missing source' end,
      case when event_type <> '' and event_type not in ('log', 'deployment', 'database', 'queue', 'health')
        then 'invalid eventType' end,
      case when severity is null then 'missing severity' when severity < 0 or severity > 5 then 'invalid severity' end,
      case when lower(trim(environment)) not in ('prod', 'production', 'staging', 'stage', 'dev', 'development')
        then 'invalid environment: ' || lower(trim(environment)) end,
      case when ts_text = 'not-a-time' then 'invalid timestamp' end], lambda x: x is not null) as errors
  from raw)"""

FLAGGED = f"""{VALIDATED},
flagged as (
  select *, row_number() over (partition by id order by batch_id, pos) > 1 as is_duplicate
  from validated where len(errors) = 0)"""

# The masking patterns as the modelled service states them.
CREDENTIALS = (
    r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|token|password|passwd|secret)\b"
    r"(\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)"
).replace(r"\"", '"')
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*"
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_mask(expr: str) -> str:
    one = f"regexp_replace({expr}, {sql_text(CREDENTIALS)}, '\\1\\2[REDACTED]', 'g')"
    two = f"regexp_replace({one}, {sql_text(BEARER)}, 'Bearer [REDACTED_TOKEN]', 'g')"
    return f"regexp_replace({two}, {sql_text(EMAIL)}, '[REDACTED_EMAIL]', 'g')"


def _row(values: tuple) -> str:
    return "(" + ", ".join("null" if v is None else str(v) if isinstance(v, int) else sql_text(str(v)) for v in values) + ")"


RULES = f"""rules(rule_id, priority, match_type, hypothesis, advice) as (values {', '.join(_row(r) for r in RULE_ROWS)}),
patterns(pattern_id, rule_id, event_type, source, env, match_type, pattern, field, bound) as (
  values {', '.join(_row(r) for r in PATTERN_ROWS)})"""

# Evidence of every session against its candidate patterns (hit or not).
CANDIDATES = """pairs as (
  select distinct m.source, m.env, m.session_start, p.pattern_id, p.rule_id
  from members m join patterns p on p.source = m.source and p.env = m.env and p.event_type = m.event_type),
hits as (
  select distinct m.source, m.env, m.session_start, p.pattern_id
  from members m join patterns p on p.source = m.source and p.env = m.env
  where case p.match_type when 'exact' then m.message = p.pattern when 'contains' then contains(m.message, p.pattern)
      when 'regex' then regexp_matches(m.message, p.pattern) else false end
    and (p.field is null or coalesce(cast(json_extract(m.payload, '$.' || p.field) as double) > cast(p.bound as double), false))),
candidates as (
  select c.*, h.pattern_id is not null as hit
  from pairs c left join hits h using (source, env, session_start, pattern_id)),
verdicts as (
  select source, env, session_start, rule_id, count(*) as pattern_count, bool_or(hit) as any_hit, bool_and(hit) as all_hit,
    string_agg(pattern_id, ',' order by pattern_id) as pattern_ids
  from candidates group by 1, 2, 3, 4),
judged as (
  select v.*, r.priority, r.match_type, r.hypothesis, r.advice,
    case r.match_type when 'single' then any_hit else all_hit end as matched
  from verdicts v join rules r using (rule_id))"""

FALLBACK_ADVICE = "|".join(FALLBACK_RECOMMENDATIONS)

# First occurrences of a '|'-separated advice text, in order.
ANALYZED = f"""folded as (
  select source, env, session_start, string_agg(hypothesis, '; ' order by priority desc, rule_id) as summary,
    count(*) as n, string_agg(advice, '|' order by priority desc, rule_id) as advice
  from judged where matched group by 1, 2, 3),
advice_rows as (
  select source, env, session_start, unnest(string_split(advice, '|')) as item,
    generate_subscripts(string_split(advice, '|'), 1) as i from folded),
advice_first as (
  select source, env, session_start, item, min(i) as i from advice_rows group by 1, 2, 3, 4),
advice_text as (
  select source, env, session_start, string_agg(item, '|' order by i) as advice from advice_first group by 1, 2, 3),
analyzed as (
  select s.source, s.env, s.session_start, s.session_end, s.max_severity,
    coalesce(f.summary, 'insufficient deterministic evidence') as analysis_summary,
    coalesce(a.advice, '{FALLBACK_ADVICE}') as recommendations,
    case when f.n is null then 'hybrid' else 'rule-based' end as analysis_source,
    coalesce(f.n, 1) as n
  from sessions s left join folded f using (source, env, session_start)
    left join advice_text a using (source, env, session_start))"""

SCORES = """array_to_string(list_transform(range(n), lambda i: cast(round(greatest(0.4,
  case analysis_source when 'rule-based' then 0.83 else 0.62 end - 0.07 * i), 2) as double)), ',')"""


def scores(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.round(x, 2).cast("string")), ",")


def joined(column: str) -> Column:
    return F.array_join(column, "|")


ANALYSIS_CTES = f"{SIGNALS}, {sessions_sql(HOUR)}, {RULES}, {CANDIDATES}, {ANALYZED}"
