"""Maintenance of the rule, pattern and allow-list tables.

Requests carry ``pos``, their place in the request stream, so that "first one
wins" has a meaning inside a batch. Every function returns DataFrames; writing
them back is the caller's choice (``sources.store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.changes import last_request
from pulseloom.operators.transactions import accepted_requests
from pulseloom.functions.payload import comparable_conditions, condition_error, normalize_keys
from pulseloom.functions.regex import jvm_regex
from pulseloom.functions.text import empty_to_null, environment_error, normalize_environment, strip

# Texts and limits of the request checks.
RULE_MATCH_TYPES = ("single", "correlation")
MESSAGE_MATCH_TYPES = ("exact", "regex", "contains")
DEFAULT_MATCH_TYPE = "ALL"
DEFAULT_PRIORITY = 100
DEFAULT_VERSION = 1
SEVERITY_MIN_RANGE = (0, 100)

RULE_KEY = (
    "name", "description", "confidence", "priority", "enabled", "match_type", "hypothesis_template",
    "recommendations", "version",
)
PATTERN_KEY = (
    "rule_id", "event_type", "source", "environment", "severity_min", "message_match_type", "message_pattern",
    "payload_conditions", "variable_mappings",
)


def _text(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit("")))


# -- request checks: the first error only -----------------------------------


def rule_error() -> Column:
    match_type = F.lower(_text("match_type"))
    return (
        F.when(_text("name") == "", F.lit("name is required"))
        .when(_text("hypothesis_template") == "", F.lit("hypothesisTemplate is required"))
        .when(~match_type.isin(*RULE_MATCH_TYPES), F.lit("The matchType value must be either SINGLE or CORRELATION."))
        .when(F.col("version") < 1, F.lit("The version must be at least 1"))
        .when(
            ~F.coalesce(F.col("confidence"), F.lit(0.0)).between(0.0, 1.0),
            F.lit("The confidence value must be between 0 and 1"),
        )
    )


def validate_rules(requests: DataFrame) -> DataFrame:
    """Rule requests with trimmed texts, defaults and ``error`` (null when fine)."""
    priority = F.when(F.col("priority").between(0, 100), F.col("priority")).otherwise(F.lit(DEFAULT_PRIORITY))
    return requests.withColumn("error", rule_error()).withColumns(
        {
            "id": _text("id"),
            "name": _text("name"),
            "description": _text("description"),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "priority": priority,
            "enabled": F.coalesce("enabled", F.lit(True)),
            "match_type": F.lower(_text("match_type")),
            "hypothesis_template": _text("hypothesis_template"),
            "version": F.coalesce("version", F.lit(DEFAULT_VERSION)),
        }
    )


def pattern_error() -> Column:
    match_type = F.lower(_text("message_match_type"))
    return (
        F.when(_text("rule_id") == "", F.lit("ruleId is required"))
        .when(
            (match_type == "") != (_text("message_pattern") == ""),
            F.lit("messageMatchType and messagePattern must be provided together"),
        )
        .when(_text("event_type") == "", F.lit("The EventType value is required"))
        .when(_text("source") == "", F.lit("The source value is required"))
        .when(_text("environment") == "", F.lit("The Environment value is required"))
        .when(environment_error(F.col("environment")).isNotNull(), environment_error(F.col("environment")))
        .when(F.col("severity_min").isNull(), F.lit("The SeverityMin value is required"))
        .when(
            ~F.col("severity_min").between(*SEVERITY_MIN_RANGE),
            F.lit("The SeverityMin value must be between 0 and 100"),
        )
        .when(
            ~match_type.isin(*MESSAGE_MATCH_TYPES),
            F.lit("The MessageMatchType value must be either EXACT, CONTAINS, or REGEX"),
        )
        .when(_text("message_pattern") == "", F.lit("The MessagePattern value is required"))
    )


def validate_patterns(requests: DataFrame) -> DataFrame:
    """Pattern requests in stored form with ``error``; the event type is free text."""
    none = F.array().cast("array<struct<field:string,operator:string,value:string>>")
    return requests.withColumn("error", pattern_error()).withColumns(
        {
            "id": _text("id"),
            "rule_id": _text("rule_id"),
            "event_type": _text("event_type"),
            "source": _text("source"),
            "environment": normalize_environment(F.col("environment")),
            "message_match_type": F.lower(_text("message_match_type")),
            "message_pattern": _text("message_pattern"),
            "payload_conditions": F.coalesce("payload_conditions", none),
            "variable_mappings": F.coalesce("variable_mappings", F.create_map().cast("map<string,string>")),
        }
    )


def parse_conditions(requests: DataFrame, column: str = "conditions_json") -> DataFrame:
    """Decode a JSON array of condition objects; unknown keys are an error.

    Adds ``payload_conditions`` (values stay JSON text) and ``condition_error``.
    """
    items = F.from_json(column, "array<variant>")
    texts = F.transform(items, lambda c: F.to_json(c))
    errors = F.array_compact(F.transform(texts, condition_error))
    conditions = F.transform(
        items,
        lambda c: F.struct(
            F.coalesce(F.try_variant_get(c, "$.field", "string"), F.lit("")).alias("field"),
            F.coalesce(F.try_variant_get(c, "$.operator", "string"), F.lit("")).alias("operator"),
            F.coalesce(F.to_json(F.try_variant_get(c, "$.value", "variant")), F.lit("null")).alias("value"),
        ),
    )
    broken = F.col(column).isNotNull() & items.isNull()
    error = F.when(broken, F.lit("invalid payload condition: not an array")).otherwise(F.get(errors, F.lit(0)))
    return requests.withColumn("condition_error", error).withColumn("payload_conditions", F.when(error.isNull(), conditions))


def with_message_regex(patterns: DataFrame) -> DataFrame:
    """Derive the JVM form of regex patterns; done when patterns are saved."""
    wanted = F.when(F.col("message_match_type") == "regex", F.col("message_pattern"))
    return patterns.withColumn("message_regex", jvm_regex(wanted))


# -- natural keys -----------------------------------------------------------


def _comparable(column: str) -> Column:
    """A value whose text is equal when the stored values are equal."""
    if column == "variable_mappings":
        return F.array_sort(F.map_entries(column))
    if column == "payload_conditions":
        return comparable_conditions(column)
    return F.col(column)


def natural_key(columns: tuple[str, ...]) -> Column:
    """Hash of the key columns; null if one is null, as null equals nothing."""
    complete = F.lit(True)
    for column in columns:
        complete = complete & F.col(column).isNotNull()
    return F.when(complete, F.sha2(F.to_json(F.struct(*[_comparable(c).alias(c) for c in columns])), 256))


def find_existing(table: DataFrame, requests: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Requests with ``existing_id``, the id of the stored row of the same key."""
    stored = table.select(natural_key(key).alias("_key"), "id").groupBy("_key").agg(F.min("id").alias("existing_id"))
    return requests.withColumn("_key", natural_key(key)).join(stored, "_key", "left")


def insert_if_absent(table: DataFrame, requests: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Returns (answers, rows to append).

    ``answers`` holds (pos, id, created). The first request of a new key creates
    the row, later ones answer with its id. Blank ids become hashes of the key.
    """
    found = find_existing(table, requests, key)
    new_id = F.coalesce(empty_to_null(F.col("id")), F.col("_key"), F.sha2(F.col("pos").cast("string"), 256))
    group = F.coalesce("_key", F.concat(F.lit("pos:"), F.col("pos").cast("string")))
    keyed = found.withColumn("_group", group).withColumn("_new_id", new_id)
    firsts = keyed.groupBy("_group").agg(
        F.min("pos").alias("_first_pos"), F.min_by("_new_id", "pos").alias("_first_id")
    )
    placed = keyed.join(firsts, "_group").withColumn(
        "created", F.col("existing_id").isNull() & (F.col("pos") == F.col("_first_pos"))
    )
    answers = placed.select("pos", F.coalesce("existing_id", "_first_id").alias("id"), "created")
    rows = placed.filter("created").withColumn("id", F.col("_first_id")).select(*requests.columns)
    return answers, rows


def insert_rules_if_absent(rules: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    with_defaults = requests.withColumns(
        {
            "match_type": F.coalesce(empty_to_null(F.col("match_type")), F.lit(DEFAULT_MATCH_TYPE)),
            "version": F.when(F.coalesce("version", F.lit(0)) == 0, F.lit(DEFAULT_VERSION)).otherwise(F.col("version")),
        }
    )
    return insert_if_absent(backfill_match_type(rules), with_defaults, RULE_KEY)


def insert_patterns_if_absent(patterns: DataFrame, requests: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As for rules; requests that name an unknown rule are left out (``unknown_rules``)."""
    known = requests.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi").select(*requests.columns)
    texts = ("event_type", "source", "environment", "message_match_type", "message_pattern")
    return insert_if_absent(patterns, known.withColumns({c: empty_to_null(F.col(c)) for c in texts}), PATTERN_KEY)


def unknown_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    return requests.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_anti")


# -- updates and deletes ----------------------------------------------------


def update_rows(table: DataFrame, updates: DataFrame, columns: tuple[str, ...], as_of: Column) -> DataFrame:
    """Replace ``columns`` of the rows named by id; other rows stay as they are.

    Several updates of one id count as requests in the order of ``pos``: the last wins.
    """
    changes = last_request(updates).select("id", F.struct(*columns).alias("_new"))
    joined = table.join(changes, "id", "left")
    hit = F.col("_new").isNotNull()
    replaced = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    replaced["updated_at"] = F.when(hit, as_of).otherwise(F.col("updated_at"))
    return joined.withColumns(replaced).select(*table.columns)


def update_rules(rules: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    return update_rows(rules, updates, RULE_KEY, as_of)


def update_patterns(patterns: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Updates must carry ``message_regex`` (``with_message_regex``) as well."""
    texts = ("event_type", "source", "environment", "message_match_type", "message_pattern")
    nulled = updates.withColumns({c: empty_to_null(F.col(c)) for c in texts})
    return update_rows(patterns, nulled, (*PATTERN_KEY, "message_regex"), as_of)


def not_found(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose id is not in the table."""
    return requests.join(table.select("id"), "id", "left_anti")


def delete_by_id(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def delete_rules(rules: DataFrame, patterns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules without the named ones, and patterns without those of deleted rules."""
    gone = ids.select(F.col("id").alias("rule_id"))
    return delete_by_id(rules, ids), patterns.join(gone, "rule_id", "left_anti").select(*patterns.columns)


def backfill_match_type(rules: DataFrame) -> DataFrame:
    return rules.withColumn("match_type", F.coalesce("match_type", F.lit(DEFAULT_MATCH_TYPE)))


# -- payload allow-list -----------------------------------------------------


def allow_list(filters: DataFrame, environment: str) -> DataFrame:
    """Keys of one environment in ascending order."""
    return filters.filter(F.col("environment") == environment).select("allow_payload").orderBy("allow_payload")


def requested_keys(requests: DataFrame) -> DataFrame:
    """(request_id, environment, allow_payload) of (request_id, environment, payloads)."""
    return requests.select(
        "request_id",
        normalize_environment(F.col("environment")).alias("environment"),
        F.explode(normalize_keys(F.col("payloads"))).alias("allow_payload"),
    )


def add_allow_keys(
    filters: DataFrame, requests: DataFrame, as_of: Column, on_conflict: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """Returns (rows to append, conflicts: request_id and key).

    Requests act in request_id order. A key that is there already is a conflict.
    With "error" it fails its whole request, as one transaction, and all its keys
    that are there when its turn comes are named; with "ignore" only that key is
    left out. ``operators.transactions`` settles who succeeds. Requests without an
    id have no place in the order and take no part.
    """
    if on_conflict not in ("error", "ignore"):
        raise ValueError(f"on_conflict must be error or ignore, not {on_conflict}")
    pair = ["environment", "allow_payload"]
    known = filters.select(*pair)
    asked = requested_keys(requests).where("request_id is not null")
    conflicts = asked.join(known, pair, "left_semi")
    if on_conflict == "ignore":
        rows = asked.join(known, pair, "left_anti").groupBy(*pair).agg(F.min("request_id").alias("_first"))
    else:
        able = asked.join(conflicts.select("request_id").distinct().hint("merge"), "request_id", "left_anti")
        rows = accepted_requests(able, pair).withColumnRenamed("request_id", "_first")
    late = asked.join(rows.hint("merge"), pair).filter(F.col("request_id") > F.col("_first")).select(*asked.columns)
    return rows.select(*pair).withColumn("updated_at", as_of), conflicts.unionByName(late)


def remove_allow_keys(filters: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (filters left, removed rows); the size of the second is the answer."""
    pair = ["environment", "allow_payload"]
    keys = requested_keys(requests).select(*pair).distinct()
    return filters.join(keys, pair, "left_anti").select(*filters.columns), filters.join(keys, pair, "left_semi")
