"""Ingest and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.catalog.base import (
    AS_OF_US,
    FLAGGED,
    HOUR,
    MINUTE,
    RAW,
    SIGNALS,
    VALIDATED,
    as_of,
    query,
    sessions_sql,
    sql_environment,
    sql_mask,
    sql_strip,
)
from pulseloom.functions import text as tx
from pulseloom.functions.payload import keys_error, normalize_keys, redact_payload
from pulseloom.operators import ingest as ing
from pulseloom.operators import sessions as ses
from pulseloom.plans.ingest import ingest
from pulseloom.session import scratch_folder
from pulseloom.sources import envelopes as env
from pulseloom.sources.tables import raw_signals, signals, table

STORED_UNTIL = "2024-01-16"  # what arrived before this day is stored already


def micros(column: str = "timestamp"):
    return F.unix_micros(column)


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).filter(F.col("timestamp") < F.lit(STORED_UNTIL).cast("timestamp"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.validate_signals(raw_signals(spark, sf_dir), as_of())


# -- envelopes --------------------------------------------------------------


def envelope_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per batch of 100 events, and beside them broken texts, each in its own way, under negative batch ids."""
    item = F.struct(
        "id",
        F.col("event_type").alias("eventType"),
        "source",
        "environment",
        "timestamp",
        "severity",
        "message",
        F.from_json("payload", "map<string,variant>").alias("payload"),
    )
    batches = (
        raw_signals(spark, sf_dir)
        .withColumn("json", F.to_json(item))
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "json"))).alias("items"))
    )
    context = F.concat(F.lit('{"sourceContext":"batch '), F.col("batch_id").cast("string"), F.lit('","signals":['))
    body = F.concat(context, F.array_join("items.json", ","), F.lit("]}"))
    broken = (
        F.when(F.col("batch_id") % 25 == 7, F.lit("{"))
        .when(F.col("batch_id") % 25 == 8, F.lit('{"signals":[]}'))
        .when(F.col("batch_id") % 25 == 10, F.lit('{"signals":[{"eventType":"log","source":5,"severity":1}]}'))
        .when(F.col("batch_id") % 25 == 11, F.concat(body, F.lit(" tail")))
        .when(F.col("batch_id") % 25 == 9, F.lit('{"signals":[{"eventType":"log","source":"s","severity":"high"}]}'))
    )
    both = F.array(F.struct("batch_id", body.alias("value")), F.struct((-F.col("batch_id") - 1).alias("batch_id"), broken.alias("value")))
    return batches.select(F.explode(both).alias("batch")).select("batch.*").where("value is not null")


@query(
    "read_envelopes",
    f"""with {RAW} select batch_id, pos, id, event_type, source, environment, ts_text as "timestamp", severity, message,
      cast(json_extract(payload, '$.k') as bigint) as k from raw""",
)
def read_envelopes(spark, sf_dir):
    """Written to files, one text a line, the broken ones among them, and read from there."""
    folder = scratch_folder(spark)
    envelope_texts(spark, sf_dir).select("value").write.text(folder)
    parsed = env.read_envelopes(spark, folder)
    sent = F.regexp_extract("envelope.sourceContext", "^batch ([0-9]+)$", 1).try_cast("bigint")
    return env.envelope_signals(parsed.withColumn("batch_id", sent)).select(
        "batch_id", "pos", "id", "event_type", "source", "environment", "timestamp", "severity", "message",
        F.get_json_object("payload", "$.k").cast("bigint").alias("k"),
    )


@query(
    "quarantine_batches",
    f"""with {RAW} select distinct -batch_id - 1 as batch_id, case when batch_id % 25 = 8
      then 'signals is required and must contain at least one item' else 'malformed body' end as reason
      from raw where batch_id % 25 in (7, 8, 9, 10, 11)""",
)
def quarantine_batches(spark, sf_dir):
    return env.quarantined_batches(env.parse_envelopes(envelope_texts(spark, sf_dir))).select("batch_id", "reason")


# -- validation -------------------------------------------------------------


@query(
    "validate_signals",
    f"""with {VALIDATED} select batch_id, pos, id, event_type, source, env, ts_us, severity,
      array_to_string(errors, '; ') as errors from validated""",
)
def validate_signals(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "batch_id", "pos", "id", "event_type", "source", "env", micros().alias("ts_us"), "severity",
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "valid_event_type",
    f"""with {RAW} select event_type, count(*) as n, event_type in ('log', 'deployment', 'database', 'queue', 'health') as ok
      from raw group by event_type""",
)
def valid_event_type(spark, sf_dir):
    return raw_signals(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ok", ing.is_event_type(F.col("event_type"))
    )


@query(
    "valid_severity",
    f"with {RAW} select severity, count(*) as n, coalesce(severity between 0 and 5, false) as ok from raw group by severity",
)
def valid_severity(spark, sf_dir):
    return raw_signals(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ok", ing.is_severity(F.col("severity"))
    )


ODD_ENVIRONMENT = """case event_id % 9 when 0 then ' PROD ' when 1 then 'stage' when 2 then concat(chr(9), 'Dev', chr(10))
  when 3 then 'production' when 4 then 'qa' when 5 then '' when 6 then null when 7 then concat('staging', chr(160))
  else concat('Env-', user_id) end"""


@query(
    "normalize_environment",
    f"""with e as (select event_id, {ODD_ENVIRONMENT} as environment from events)
    select event_id, {sql_environment('environment')} as env,
      case when {sql_environment('environment')} not in ('production', 'staging', 'development')
        then 'invalid environment: ' || lower({sql_strip('environment')}) end as error from e""",
)
def normalize_environment(spark, sf_dir):
    odd = table(spark, sf_dir, "events").selectExpr("event_id", f"{ODD_ENVIRONMENT} as environment")
    return odd.select(
        "event_id",
        tx.normalize_environment(F.col("environment")).alias("env"),
        tx.environment_error(F.col("environment")).alias("error"),
    )


# Time texts in many shapes, legal and not, built from every event's own time.
_DAY_SPARK, _DAY_DUCK = "date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"
_TIME_SPARK, _TIME_DUCK = "date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"


def _time_text(day: str, time: str) -> str:
    return f"""case event_id % 16 when 0 then concat({day}, 'T', {time}, 'Z')
      when 1 then concat({day}, 'T', {time}, '.123456Z') when 2 then concat({day}, 'T', {time}, '.5+05:30')
      when 3 then concat({day}, 'T', {time}, '-08:00') when 4 then concat({day}, 'T', {time}, ',25Z')
      when 5 then concat({day}, ' ', {time}, 'Z') when 6 then concat({day}, 'T', {time})
      when 7 then concat({day}, 'T', {time}, 'z') when 8 then '2024-02-30T00:00:00Z'
      when 9 then concat({day}, 'T', {time}, 'Z', chr(10)) when 10 then {day}
      when 11 then null when 12 then '' when 13 then concat({day}, 'T25', substr({time}, 3), 'Z')
      when 14 then concat({day}, 'T', {time}, '+24:30') else concat({day}, 'T', {time}, '+5:00') end"""


@query(
    "parse_rfc3339",
    f"""with e as (select event_id, {_time_text(_DAY_DUCK, _TIME_DUCK)} as t from events),
    shaped as (select event_id, t, regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-4]):([0-5][0-9]|60))') as ok from e),
    cut as (select event_id, t, ok, try_cast(replace(replace(regexp_replace(t, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', ''), ',', '.'), 'T', ' ') as timestamp) as local,
      case when right(t, 1) = 'Z' then 0 else (try_cast(left(right(t, 5), 2) as integer) * 60 + try_cast(right(t, 2) as integer))
        * case when left(right(t, 6), 1) = '-' then -1 else 1 end end as off from shaped)
    select event_id, case when t is null or t = '' then {AS_OF_US}
      when ok then epoch_us(local) - cast(off as bigint) * 60000000 end as ts_us from cut""",
)
def parse_rfc3339(spark, sf_dir):
    texts = table(spark, sf_dir, "events").selectExpr("event_id", f"{_time_text(_DAY_SPARK, _TIME_SPARK)} as t")
    parsed = tx.parse_rfc3339(F.col("t"))
    return texts.select(
        "event_id", F.unix_micros(F.when(F.coalesce("t", F.lit("")) == "", as_of()).otherwise(parsed)).alias("ts_us")
    )


@query(
    "default_ids",
    f"""with {RAW} select batch_id, pos, case when pos % 4 = 0 then sha256(batch_id || ':' || pos) else id end as id from raw""",
)
def default_ids(spark, sf_dir):
    given = F.when(F.col("pos") % 4 != 0, F.col("id"))
    return raw_signals(spark, sf_dir).select(
        "batch_id", "pos", ing.default_id(given, F.col("batch_id"), F.col("pos")).alias("id")
    )


@query(
    "explode_errors",
    f"""with {VALIDATED} select batch_id, pos, cast(i - 1 as integer) as error_pos, 'signal ' || pos || ': ' || errors[i] as error
    from validated, unnest(generate_series(1, len(errors))) as g(i)""",
)
def explode_errors(spark, sf_dir):
    return ing.rejected_errors(validated(spark, sf_dir))


@query(
    "ingest_error_pages",
    f"""with {VALIDATED}, rows as (
      select batch_id, 'signal ' || pos || ': ' || errors[i] as error,
        row_number() over (partition by batch_id order by pos, i) - 1 as position
      from validated, unnest(generate_series(1, len(errors))) as g(i))
    select batch_id, cast(floor(position / 20) as bigint) as page, string_agg(error, '; ' order by position) as errors
    from rows group by 1, 2""",
)
def ingest_error_pages(spark, sf_dir):
    pages = ing.error_pages(validated(spark, sf_dir), page_rows=20)
    return pages.select("batch_id", "page", F.array_join("values", "; ").alias("errors"))


@query(
    "default_timestamps",
    f"""select event_id, case when event_id % 5 in (0, 1) then {AS_OF_US} else epoch_us(ts) end as ts_us from events""",
)
def default_timestamps(spark, sf_dir):
    zero = F.timestamp_micros(F.lit(tx.ZERO_TIME_US))
    given = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, zero).otherwise(
        F.col("ts").cast("timestamp")
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(tx.default_timestamp(given, as_of())).alias("ts_us")
    )


@query(
    "normalize_keys",
    f"""with l as (select doc_id, string_split(text, ' ') as words from documents),
    u as (select doc_id, trim(w, {"' ' || chr(9) || chr(10) || chr(13)"}) as w, i from (
        select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from l)),
    f as (select doc_id, w, min(i) as i from u where w <> '' group by 1, 2)
    select l.doc_id, coalesce(string_agg(f.w, ' ' order by f.i), '') as keys,
      case when count(f.w) = 0 then 'payloads must contain at least one key' end as error
    from l left join f using (doc_id) group by l.doc_id""",
)
def normalize_keys_query(spark, sf_dir):
    words = table(spark, sf_dir, "documents").withColumn("words", F.split("text", " "))
    return words.select(
        "doc_id",
        F.array_join(normalize_keys(F.col("words")), " ").alias("keys"),
        keys_error(F.col("words")).alias("error"),
    )


@query(
    "empty_to_null",
    f"with {RAW} select nullif(source, '') as source, count(*) as n from raw group by 1",
)
def empty_to_null(spark, sf_dir):
    return raw_signals(spark, sf_dir).groupBy(tx.empty_to_null(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n")
    )


# -- duplicates and storage -------------------------------------------------

_STORED_SQL = f"""{FLAGGED},
stored as (select 'evt-' || event_id as id from events where ts < timestamp '{STORED_UNTIL}'),
checked as (
  select f.*, f.is_duplicate or s.id is not null as dup from flagged f left join stored s using (id))"""


@query(
    "duplicate_signals",
    f"with {_STORED_SQL} select batch_id, pos, id from checked where dup",
)
def duplicate_signals(spark, sf_dir):
    rows = validated(spark, sf_dir)
    repeated = ing.duplicate_signals(ing.valid_signals(rows), stored_signals(spark, sf_dir), rows)
    return repeated.select("batch_id", "pos", "id")


@query(
    "first_write_wins",
    f"with {FLAGGED} select batch_id, pos, id, event_type, source, env, ts_us, severity from flagged where not is_duplicate",
)
def first_write_wins(spark, sf_dir):
    accepted = ing.accepted_signals(ing.valid_signals(validated(spark, sf_dir)))
    return accepted.select(
        "batch_id", "pos", "id", "event_type", "source", "env", micros().alias("ts_us"), "severity"
    )


@query(
    "insert_signals",
    f"""with {_STORED_SQL} select id, event_type, source, env, ts_us, severity, {sql_mask('message')} as message,
      cast(json(payload) as varchar) as payload from checked where not dup""",
)
def insert_signals(spark, sf_dir):
    rows = validated(spark, sf_dir)
    fresh = ing.accepted_signals(ing.valid_signals(rows), stored_signals(spark, sf_dir), rows)
    return ing.stored_form(fresh, F.array(F.lit("k"))).select(
        "id", "event_type", "source", "env", micros().alias("ts_us"), "severity", "message", "payload"
    )


@query(
    "upsert_signals",
    f"""with {FLAGGED}, {SIGNALS},
    old as (select s.id, s.severity, s.ts_us from signals s join events e on s.id = 'evt-' || e.event_id
      where e.ts < timestamp '{STORED_UNTIL}'),
    latest as (select id, severity, ts_us from (
      select *, row_number() over (partition by id order by batch_id desc, pos desc) as rn from flagged) where rn = 1)
    select * from latest union all select * from old where id not in (select id from latest)""",
)
def upsert_signals(spark, sf_dir):
    incoming = ing.valid_signals(validated(spark, sf_dir)).select("id", "severity", "timestamp", "batch_id", "pos")
    stored = stored_signals(spark, sf_dir).select("id", "severity", "timestamp")
    return ing.upsert_signals(stored, incoming).select("id", "severity", micros().alias("ts_us"))


@query(
    "accepted_fanout",
    f"""with {FLAGGED} select 'job' as branch, id, message from flagged where not is_duplicate
    union all select 'store', id, {sql_mask('message')} from flagged where not is_duplicate""",
)
def accepted_fanout(spark, sf_dir):
    result = ingest(raw_signals(spark, sf_dir), as_of())
    job = result.accepted.select(F.lit("job").alias("branch"), "id", "message")
    return job.unionByName(result.stored.select(F.lit("store").alias("branch"), "id", "message"))


@query(
    "ingest_summary",
    f"""with {_STORED_SQL},
    counted as (
      select batch_id, count(*) filter (not dup) as accepted_count, count(*) filter (dup) as duplicate_count, 0 as rejected_count
      from checked group by 1
      union all select batch_id, 0, 0, count(*) from validated where len(errors) > 0 group by 1),
    total as (select batch_id, cast(sum(accepted_count) as bigint) as accepted_count,
        cast(sum(duplicate_count) as bigint) as duplicate_count, cast(sum(rejected_count) as bigint) as rejected_count
      from counted group by 1)
    select batch_id, case when accepted_count > 0 then sha256('job:' || batch_id) else '' end as ingestion_id,
      accepted_count, duplicate_count, rejected_count from total""",
)
def ingest_summary(spark, sf_dir):
    return ing.ingest_summary(ing.classified_signals(validated(spark, sf_dir), stored_signals(spark, sf_dir)))


@query(
    "lookup_signal",
    f"""with {SIGNALS} select id, source, env, ts_us from signals
      where id in (select 'evt-' || o_custkey from orders)""",
)
def lookup_signal(spark, sf_dir):
    from pulseloom.operators.incidents import lookup

    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("evt-"), F.col("o_custkey").cast("string")).alias("id"))
    return lookup(signals(spark, sf_dir), ids).select("id", "source", "env", micros().alias("ts_us"))


# -- masking ----------------------------------------------------------------


@query("sanitize_documents", f"select doc_id, {sql_mask('text')} as text from documents")
def sanitize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_message(F.col("text")).alias("text"))


@query("sanitize_messages", f"with {SIGNALS} select id, {sql_mask('message')} as message from signals")
def sanitize_messages(spark, sf_dir):
    return signals(spark, sf_dir).select("id", tx.sanitize_message(F.col("message")).alias("message"))


@query("sanitize_conversations", f"select conv_id, turn, {sql_mask('text')} as text from conversations")
def sanitize_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.sanitize_message(F.col("text")).alias("text"))


_RICH_SPARK = """concat('{"k":', get_json_object(props, '$.k'), ',"secret":"x', user_id, '","ok":true,"none":null,"db.host":"h',
  event_id % 10, '","list":[1,2]}')"""


@query(
    "redact_payload",
    """select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"ok":true,"none":null,"db.host":"h' || (event_id % 10) || '"}'
      as payload from events""",
)
def redact_payload_query(spark, sf_dir):
    rich = table(spark, sf_dir, "events").selectExpr("event_id", f"{_RICH_SPARK} as payload")
    allowed = F.array(*[F.lit(k) for k in ("k", "ok", "none", "db.host", "absent")])
    return rich.select("event_id", redact_payload(F.col("payload"), allowed).alias("payload"))


@query(
    "redact_payload_per_environment",
    f"""with {SIGNALS} select id, env, case env when 'production' then '{{}}' else cast(json(payload) as varchar) end as payload
      from signals""",
)
def redact_payload_per_environment(spark, sf_dir):
    """Each environment's own keys; the filter rows come from the distinct signals' environments."""
    base = signals(spark, sf_dir)
    filters = base.select(F.col("env").alias("environment")).distinct().filter("environment <> 'development'").withColumn(
        "allow_payload", F.when(F.col("environment") == "production", F.lit("other")).otherwise(F.lit("k"))
    )
    stored = ing.stored_form(base, filters)
    # Environments without keys keep the payload text as it came; compare its parsed form.
    return stored.select("id", "env", F.to_json(F.from_json("payload", "map<string,variant>")).alias("payload"))


# -- sessions ---------------------------------------------------------------


def _session_rows(spark, sf_dir, window_us):
    return ses.session_summary(signals(spark, sf_dir), window_us).select(
        "source", "env", "session_start", "session_end", "signal_count", "max_severity"
    )


@query("sessionize_60s", f"with {SIGNALS}, {sessions_sql(MINUTE)} select * from sessions")
def sessionize_60s(spark, sf_dir):
    return _session_rows(spark, sf_dir, MINUTE)


@query("sessionize_1h", f"with {SIGNALS}, {sessions_sql(HOUR)} select * from sessions")
def sessionize_1h(spark, sf_dir):
    return _session_rows(spark, sf_dir, HOUR)


@query("sessionize_bucketed", f"with {SIGNALS}, {sessions_sql(10 * MINUTE)} select id, session_start from members")
def sessionize_bucketed(spark, sf_dir):
    """Sessions found in buckets of an hour, six cells each, and stitched over the buckets they cross."""
    return ses.session_members(signals(spark, sf_dir), 10 * MINUTE, bucket_us=HOUR).select("id", "session_start")


@query(
    "session_summary",
    f"""with {SIGNALS}, {sessions_sql(HOUR)},
    numbered as (select *, row_number() over (partition by source, env, session_start order by ts_us, id) - 1 as position
      from members)
    select source, env, session_start, cast(floor(position / 3) as bigint) as page,
      string_agg(id, ',' order by position) as signal_ids from numbered group by 1, 2, 3, 4""",
)
def session_summary(spark, sf_dir):
    pages = ses.session_signal_ids(signals(spark, sf_dir), HOUR, page_rows=3)
    return pages.select("source", "env", "session_start", "page", F.array_join("values", ",").alias("signal_ids"))


@query(
    "signal_order",
    f"""with {SIGNALS} select id, source, env,
      row_number() over (partition by source, env order by ts_us, id) - 1 as position from signals""",
)
def signal_order(spark, sf_dir):
    rows = signals(spark, sf_dir).select("id", "source", "env", micros().alias("ts_us"))
    return ses.add_position(rows, ["source", "env"], ["ts_us", "id"]).select("id", "source", "env", "position")


@query(
    "high_severity_groups",
    f"with {SIGNALS}, {sessions_sql(HOUR)} select source, env, session_start, max_severity from sessions where max_severity >= 4",
)
def high_severity_groups(spark, sf_dir):
    return ses.high_severity_sessions(_session_rows(spark, sf_dir, HOUR)).select(
        "source", "env", "session_start", "max_severity"
    )


@query(
    "max_group_severity",
    f"""with {SIGNALS}, {sessions_sql(HOUR)} select max_severity, count(*) as sessions from sessions group by 1""",
)
def max_group_severity(spark, sf_dir):
    return _session_rows(spark, sf_dir, HOUR).groupBy("max_severity").agg(F.count(F.lit(1)).alias("sessions"))
