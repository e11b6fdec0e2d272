"""Validation, duplicate detection and the storage form of incoming signals.

Input rows name their batch and their 0-based position in it:
batch_id, pos, id, event_type, source, environment, timestamp (text), severity,
message, payload (JSON text), metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.payload import redact_payload
from pulseloom.functions.text import (
    ZERO_TIME_US,
    empty_to_null,
    environment_error,
    normalize_environment,
    parse_rfc3339,
    sanitize_message,
)
from pulseloom.operators.sessions import PAGE_ROWS, add_position, paged_lists
from pulseloom.session import broadcast_if_small

# Event types and severities that are accepted.
EVENT_TYPES = ("log", "deployment", "database", "queue", "health")
SEVERITY_RANGE = (0, 5)

ACCEPTED, DUPLICATE, REJECTED = "accepted", "duplicate", "rejected"


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def is_event_type(event_type: Column) -> Column:
    return event_type.isin(*EVENT_TYPES)


def is_severity(severity: Column) -> Column:
    return severity.isNotNull() & severity.between(*SEVERITY_RANGE)


def signal_errors(event_type: Column, source: Column, severity: Column, environment: Column, timestamp: Column) -> Column:
    """All errors of one signal, in the order clients see them."""
    checks = F.array(
        F.when(_blank(event_type), F.lit("missing eventType")),
        F.when(_blank(source), F.lit("missing source")),
        F.when(~_blank(event_type) & ~is_event_type(event_type), F.lit("invalid eventType")),
        F.when(severity.isNull(), F.lit("missing severity")).when(~is_severity(severity), F.lit("invalid severity")),
        environment_error(environment),
        F.when(~_blank(timestamp) & parse_rfc3339(timestamp).isNull(), F.lit("invalid timestamp")),
    )
    return F.array_compact(checks)


def signal_is_valid(event_type: Column, source: Column, severity: Column, environment: Column, timestamp: Column) -> Column:
    """Whether ``signal_errors`` is empty, as one generated expression without lists."""
    checks = (
        F.coalesce(is_event_type(event_type), F.lit(False)),
        ~_blank(source),
        is_severity(severity),
        environment_error(environment).isNull(),
        _blank(timestamp) | parse_rfc3339(timestamp).isNotNull(),
    )
    return reduce(Column.__and__, checks)


def default_id(given: Column, batch_id: Column, pos: Column) -> Column:
    """The given id, else one derived from the position, so replays agree."""
    derived = F.sha2(F.concat_ws(":", batch_id.cast("string"), pos.cast("string")), 256)
    return F.coalesce(empty_to_null(given), derived)


def signal_time(text: Column, as_of: Column) -> Column:
    """The instant of a time text: ``as_of`` if blank or the unset instant, null if malformed."""
    parsed = parse_rfc3339(text)
    unset = _blank(text) | F.coalesce(F.unix_micros(parsed) == F.lit(ZERO_TIME_US), F.lit(False))
    return F.when(unset, as_of).otherwise(parsed)


def validate_signals(raw: DataFrame, as_of: Column) -> DataFrame:
    """Typed signals with ``is_valid`` and the list of their ``errors``.

    Errors are only computed where they are read; the valid branch prunes them.
    """
    c = F.col
    checked = (c("event_type"), c("source"), c("severity"), c("environment"), c("timestamp"))
    return raw.select(
        "batch_id",
        "pos",
        default_id(c("id"), c("batch_id"), c("pos")).alias("id"),
        "event_type",
        "source",
        normalize_environment(c("environment")).alias("env"),
        signal_time(c("timestamp"), as_of).alias("timestamp"),
        "severity",
        F.coalesce(c("message"), F.lit("")).alias("message"),
        "payload",
        "metadata",
        signal_is_valid(*checked).alias("is_valid"),
        signal_errors(*checked).alias("errors"),
    )


def valid_signals(validated: DataFrame) -> DataFrame:
    return validated.filter("is_valid").drop("is_valid", "errors")


def rejected_errors(validated: DataFrame) -> DataFrame:
    """One row per error: batch, position, order within the signal, client text."""
    return validated.filter(~F.col("is_valid")).select(
        "batch_id",
        "pos",
        F.posexplode("errors").alias("error_pos", "_error"),
    ).withColumn("error", F.concat(F.lit("signal "), F.col("pos").cast("string"), F.lit(": "), F.col("_error"))).drop("_error")


def error_pages(validated: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Ordered error texts of every batch, in pages."""
    errors = add_position(rejected_errors(validated), ["batch_id"], ["pos", "error_pos"])
    return paged_lists(errors, ["batch_id"], "error", page_rows)


def known_ids(valid: DataFrame, stored_ids: DataFrame | None = None, incoming_ids: DataFrame | None = None) -> DataFrame:
    """Ids that make duplicates: (id, first place, stored already or not).

    Only (id, batch_id, pos) is shuffled, reduced before the shuffle. Stored ids
    are met by a semi join against ``incoming_ids``, which may hold invalid rows
    too (default: the valid ones). Their size is measured: a small batch is
    broadcast, and the store is read without a shuffle.
    """
    ids = valid.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("batch_id", "pos")).alias("_first"))
    if stored_ids is None:
        return ids.filter("_n > 1").select("id", "_first", F.lit(False).alias("_stored"))
    incoming = broadcast_if_small((valid if incoming_ids is None else incoming_ids).select("id"))
    stored = stored_ids.select("id").join(incoming, "id", "left_semi").distinct()
    both = ids.join(stored.withColumn("_stored", F.lit(True)), "id", "left")
    return both.filter("_n > 1 or _stored").select("id", "_first", F.coalesce("_stored", F.lit(False)).alias("_stored"))


def flag_duplicates(
    valid: DataFrame, stored_ids: DataFrame | None = None, incoming_ids: DataFrame | None = None
) -> DataFrame:
    """Add ``is_duplicate``: the id is stored already, or an earlier row has it.

    The join meets only repeated and stored ids. They are computed once and
    measured: normally few, they are broadcast and the signals are not shuffled.
    Otherwise a hot id on the left is split by the skew join.
    """
    late = F.col("_stored") | (F.col("_first") != F.struct("batch_id", "pos"))
    return (
        valid.join(broadcast_if_small(known_ids(valid, stored_ids, incoming_ids), materialize=True), "id", "left")
        .withColumn("is_duplicate", F.coalesce(late, F.lit(False)))
        .select(*valid.columns, "is_duplicate")
    )


def duplicate_signals(
    valid: DataFrame, stored_ids: DataFrame | None = None, incoming_ids: DataFrame | None = None
) -> DataFrame:
    return flag_duplicates(valid, stored_ids, incoming_ids).filter("is_duplicate").drop("is_duplicate")


def accepted_signals(
    valid: DataFrame, stored_ids: DataFrame | None = None, incoming_ids: DataFrame | None = None
) -> DataFrame:
    """First write wins on id: what goes on to storage and to correlation (raw text)."""
    return flag_duplicates(valid, stored_ids, incoming_ids).filter(~F.col("is_duplicate")).drop("is_duplicate")


def stored_form(accepted: DataFrame, allow_list: Column | DataFrame | None = None) -> DataFrame:
    """What may be stored: message masked, payload cut to the allow-list.

    ``allow_list`` is one array for all signals, or the filter table to apply
    each environment's own keys. Rules keep seeing the raw form.
    """
    masked = accepted.withColumn("message", sanitize_message(F.col("message")))
    if allow_list is None:
        return masked
    if isinstance(allow_list, DataFrame):
        per_env = allow_list.groupBy(F.col("environment").alias("env")).agg(
            F.collect_set("allow_payload").alias("_allowed")
        )
        return masked.join(per_env, "env", "left").withColumn(
            "payload", redact_payload(F.col("payload"), F.col("_allowed"))
        ).select(*accepted.columns)
    return masked.withColumn("payload", redact_payload(F.col("payload"), allow_list))


def outcomes(flagged: DataFrame, validated: DataFrame) -> DataFrame:
    """(batch_id, pos, outcome) from the flagged valid rows and the invalid ones."""
    outcome = F.when(F.col("is_duplicate"), F.lit(DUPLICATE)).otherwise(F.lit(ACCEPTED))
    good = flagged.select("batch_id", "pos", outcome.alias("outcome"))
    return good.unionByName(validated.filter(~F.col("is_valid")).select("batch_id", "pos", F.lit(REJECTED).alias("outcome")))


def classified_signals(validated: DataFrame, stored_ids: DataFrame | None = None) -> DataFrame:
    """The outcome of every signal that came in, over narrow rows only."""
    narrow = valid_signals(validated).select("id", "batch_id", "pos")
    return outcomes(flag_duplicates(narrow, stored_ids, validated), validated)


def ingest_summary(classified: DataFrame) -> DataFrame:
    """Counters per batch; the ingestion id is empty when nothing was accepted."""
    accepted = F.count_if(F.col("outcome") == ACCEPTED)
    return classified.groupBy("batch_id").agg(
        F.when(accepted > 0, F.sha2(F.concat(F.lit("job:"), F.col("batch_id").cast("string")), 256))
        .otherwise(F.lit(""))
        .alias("ingestion_id"),
        accepted.alias("accepted_count"),
        F.count_if(F.col("outcome") == DUPLICATE).alias("duplicate_count"),
        F.count_if(F.col("outcome") == REJECTED).alias("rejected_count"),
    )


def upsert_signals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last write wins on id: the latest incoming row replaces the stored one."""
    latest = incoming.groupBy("id").agg(F.max_by(F.struct(*incoming.columns), F.struct("batch_id", "pos")).alias("_row"))
    columns = stored.columns
    return stored.join(latest.select("id"), "id", "left_anti").select(*columns).unionByName(
        latest.select("_row.*").select(*columns)
    )
