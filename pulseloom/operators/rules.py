"""Rules as data: candidate selection, matching and the analysis of sessions.

Rules and patterns are dimension tables. No broadcast is forced: Spark
broadcasts them while their measured size is under its limit and shuffles
otherwise. Signals meet patterns once, row by row; what leaves the scan is one
small row per (key, cell, event type, hit pattern).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.analysis import (
    RULE_BASED,
    analysis_source,
    analysis_summary,
    confidence_scores,
    dedupe_strings,
    fallback_hypotheses,
    fallback_recommendations,
    max_severity,
)
from pulseloom.functions.literals import message_grams, pattern_grams
from pulseloom.functions.payload import typed_conditions, typed_conditions_hold
from pulseloom.functions.text import strip
from pulseloom.operators.sessions import DEFAULT_WINDOW_US, SESSION_KEYS, is_high, mark_sessions, with_cell
from pulseloom.session import broadcast_if_small, checkpointed

MATCH_SINGLE = "single"  # any pattern; every other match type asks for all


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled")


def active_patterns(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Usable patterns of enabled rules.

    A semi join keeps the size estimate of the pattern table, which is what the
    broadcast decision of the signal join looks at.
    """
    usable = F.col("severity_min").isNotNull() & F.col("message_match_type").isNotNull() & F.col("message_pattern").isNotNull()
    return patterns.filter(usable).join(
        enabled_rules(rules).select(F.col("id").alias("rule_id")), "rule_id", "left_semi"
    )


def unusable_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns a lookup cannot read: they are reported instead of evaluated."""
    return patterns.filter(
        F.col("severity_min").isNull() | F.col("message_match_type").isNull() | F.col("message_pattern").isNull()
    )


def message_exact(message: Column, pattern: Column) -> Column:
    return F.coalesce(message, F.lit("")) == pattern


def message_contains(message: Column, pattern: Column) -> Column:
    return F.contains(F.coalesce(message, F.lit("")), pattern)


def message_regex(message: Column, regex: Column) -> Column:
    return F.rlike(F.coalesce(message, F.lit("")), regex)


def message_matches(message: Column, match_type: Column, pattern: Column, regex: Column) -> Column:
    """Unknown match types and refused regex patterns (null) are false."""
    return F.coalesce(
        F.when(match_type == "exact", message_exact(message, pattern))
        .when(match_type == "contains", message_contains(message, pattern))
        .when(match_type == "regex", message_regex(message, regex)),
        F.lit(False),
    )


def pattern_hits(signals: DataFrame, patterns: DataFrame, enforce_severity_min: bool = False) -> DataFrame:
    """Every signal with the patterns it meets, or once with a null pattern.

    Patterns apply by source and environment only; the event type of a pattern
    selects candidates for a whole session, not single signals. The message is
    tested in the join, the payload is parsed only for rows that pass it.
    """
    wanted = _pattern_columns(patterns)
    meets = _pattern_meets(signals, enforce_severity_min)
    return signals.join(wanted, meets, "left").select(*signals.columns, _conditions_hit().alias("pattern_id"))


def _pattern_columns(patterns: DataFrame, *more: str) -> DataFrame:
    return patterns.select(
        F.col("id").alias("pattern_id"),
        F.col("source").alias("_p_source"),
        F.col("environment").alias("_p_env"),
        F.col("message_match_type").alias("_p_type"),
        F.col("message_pattern").alias("_p_text"),
        F.col("message_regex").alias("_p_regex"),
        typed_conditions("payload_conditions").alias("_p_conditions"),
        F.col("severity_min").alias("_p_severity"),
        *more,
    )


def _pattern_meets(signals: DataFrame, enforce_severity_min: bool) -> Column:
    meets = (
        (strip(signals["source"]) == F.col("_p_source"))
        & (strip(signals["env"]) == F.col("_p_env"))
        & message_matches(signals["message"], F.col("_p_type"), F.col("_p_text"), F.col("_p_regex"))
    )
    return meets & (signals["severity"] >= F.col("_p_severity")) if enforce_severity_min else meets


def _conditions_hit() -> Column:
    return F.when(F.col("pattern_id").isNotNull() & typed_conditions_hold("payload", "_p_conditions"), F.col("pattern_id"))


def literal_index(patterns: DataFrame) -> DataFrame:
    """pattern_id, gram: for every pattern the piece of text each of its matches has that fewest patterns have; null if none is sure.

    Made once when rules are saved; a row per pattern.
    """
    grams = patterns.select(F.col("id").alias("pattern_id"), pattern_grams(F.col("message_match_type"), F.col("message_pattern")).alias("grams"))
    each = checkpointed(grams.select("pattern_id", F.explode_outer("grams").alias("gram")))
    common = each.groupBy(F.col("gram").alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    counted = each.join(common, F.col("gram").eqNullSafe(F.col("_of")))
    return counted.groupBy("pattern_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


# What a pattern asks of a signal; patterns that agree in all of it have the same hits.
_TEST = ("source", "environment", "message_match_type", "message_pattern", "message_regex", "payload_conditions", "severity_min")

# Ids of one test that stay together: a hit is one row for so many, and a Parquet page of 20,000 rows still holds them many
# times. A multiple of 8: Parquet packs 8 values at a time, so equal groups are equal bytes.
ID_GROUP = 1024


def indexed_pattern_hits(signals: DataFrame, patterns: DataFrame, index: DataFrame, enforce_severity_min: bool = False) -> DataFrame:
    """:func:`pattern_hits` for many patterns: a message is tested only against patterns whose gram it has.

    A signal is spread over its message's grams, which meet the index by equality,
    and over one row without a gram, which meets the patterns that have none, or
    comes out with a null pattern. So each signal comes out at least once, and once
    with each pattern it meets. Patterns that ask the same are tested once, and a hit
    is then spread over their ids. The index is joined
    by broadcast if it is small, as rule tables are; signals then stay in place,
    unless so many patterns ask the same that their ids go in groups.
    """
    spread = F.explode(F.concat(F.array(F.lit(None).cast("string")), message_grams(F.col("message")))).alias("_gram")
    rows = signals.select("*", spread)
    held = checkpointed(
        patterns.join(index.select(F.col("pattern_id").alias("id"), "gram"), "id")
        .select("id", *_TEST, "gram")
        .withColumn("_test", F.sha2(F.to_json(F.struct(*_TEST, "gram")), 256))
    )
    tests = _pattern_columns(held.dropDuplicates(["_test"]).withColumn("id", F.col("_test")), "gram")
    wanted = broadcast_if_small(tests, materialize=True)
    found = rows.join(wanted, _pattern_meets(rows, enforce_severity_min) & F.col("_gram").eqNullSafe(F.col("gram")), "left")
    hits = found.select(*signals.columns, "_gram", _conditions_hit().alias("_hit")).where("_gram is null or _hit is not null").drop("_gram")
    return _with_pattern_ids(hits, held).select(*signals.columns, "pattern_id")


def _with_pattern_ids(hits: DataFrame, held: DataFrame) -> DataFrame:
    """Hits, each spread over the ids of all patterns that ask its test; a hit of null comes out once, with a null id.

    If a test has more than ID_GROUP ids, these go in groups of so many. Hits are dealt over tasks by test, group
    and a share of the signals, and the merge join leaves the hits of a group side by side: a Parquet page then
    repeats the same few ids, and a file holds few ids and few signals, so a result of signals times patterns
    packs well. The number of tasks is fixed here, since adaptive execution would join them by their bytes
    before the hits are spread.
    """
    asked = held.groupBy("_test").agg(F.count(F.lit(1)).alias("_ids"))
    ids = asked.agg(F.max("_ids").alias("most"), F.sum("_ids").alias("all")).first()
    if (ids["most"] or 0) <= ID_GROUP:
        named = broadcast_if_small(held.select("_test", F.col("id").alias("pattern_id")))
        return hits.join(named, F.col("_hit") == F.col("_test"), "left")
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids["all"] // ID_GROUP)
    shares = 1 + tasks // 128
    buckets = F.ceil(F.col("_ids") / (16 * ID_GROUP))
    in_bucket = Window.partitionBy("_test", "_bucket").orderBy("id")
    grouped = checkpointed(
        held.join(asked, "_test")
        .withColumn("_bucket", F.pmod(F.xxhash64("id"), buckets))
        .select("_test", "id", (F.col("_bucket") + buckets * F.floor((F.row_number().over(in_bucket) - 1) / ID_GROUP)).alias("_group"))
    )
    groups = grouped.groupBy("_test").agg(F.sort_array(F.collect_set("_group")).alias("_groups"))
    tests = broadcast_if_small(groups.withColumn("_no", F.monotonically_increasing_id()), materialize=True)
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share")
    named = grouped.join(tests, "_test").select("_no", "_group", every_share, F.col("id").alias("pattern_id"))
    dealt = (
        hits.join(tests, F.col("_hit") == F.col("_test"), "left")
        .withColumn("_share", F.pmod(F.shiftright(F.monotonically_increasing_id(), 12), F.lit(shares)).cast("int"))
        .withColumn("_group", F.explode_outer("_groups"))
        .repartition(tasks, "_no", "_group", "_share")
    )
    return dealt.join(named.hint("merge"), ["_no", "_group", "_share"], "left")


def session_evidence(
    signals: DataFrame,
    patterns: DataFrame,
    window_us: int = DEFAULT_WINDOW_US,
    keys: Sequence[str] = SESSION_KEYS,
    enforce_severity_min: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """One row per session: bounds, largest severity, event types, hit patterns.

    Both arrays are sets whose size is bounded by the rule tables and the event
    types, not by the signals. All aggregates ignore the repeats the join adds.
    With an ``index`` of the patterns (:func:`literal_index`) messages meet only
    the patterns it names.
    """
    columns = list(dict.fromkeys([*keys, "source", "env", "event_type", "severity", "message", "payload", "timestamp"]))
    rows = signals.select(*columns)
    found = pattern_hits(rows, patterns, enforce_severity_min) if index is None else indexed_pattern_hits(rows, patterns, index, enforce_severity_min)
    hits = with_cell(found, window_us)
    cells = hits.groupBy(*keys, "cell", "event_type", "pattern_id").agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        max_severity(F.col("severity")).alias("max_severity"),
    )
    return (
        mark_sessions(cells, window_us, keys)
        .groupBy(*keys, "session_start")
        .agg(
            F.max("last_us").alias("session_end"),
            F.max("max_severity").alias("max_severity"),
            F.collect_set("event_type").alias("event_types"),
            F.collect_set("pattern_id").alias("hit_patterns"),
        )
    )


def candidate_patterns(
    evidence: DataFrame, patterns: DataFrame, keys: Sequence[str] = SESSION_KEYS, how: str = "inner"
) -> DataFrame:
    """(session, pattern) pairs: source and environment equal, event type seen.

    ``how="left"`` also keeps sessions without a candidate, with null pattern
    columns, so an analysis needs no second pass over the evidence.
    """
    wanted = patterns.select(
        F.col("id").alias("pattern_id"),
        "rule_id",
        F.col("event_type").alias("_p_event"),
        F.col("source").alias("_p_source"),
        F.col("environment").alias("_p_env"),
        F.col("created_at").alias("pattern_created_at"),
    )
    seen = evidence.withColumn("event_type", F.explode("event_types"))
    eligible = (
        (strip(seen["source"]) == F.col("_p_source"))
        & (strip(seen["env"]) == F.col("_p_env"))
        & (seen["event_type"] == F.col("_p_event"))
    )
    return seen.join(wanted, eligible, how).select(
        *keys,
        "session_start",
        "session_end",
        "max_severity",
        "rule_id",
        "pattern_id",
        "pattern_created_at",
        F.array_contains("hit_patterns", F.col("pattern_id")).alias("hit"),
    )


def candidate_rules(
    evidence: DataFrame, rules: DataFrame, patterns: DataFrame, keys: Sequence[str] = SESSION_KEYS, how: str = "inner"
) -> DataFrame:
    """One row per (session, rule) with its candidate patterns in created order."""
    wanted = rules.select(
        F.col("id").alias("rule_id"),
        "priority",
        "match_type",
        "hypothesis_template",
        F.col("recommendations").alias("advice"),
        F.col("created_at").alias("rule_created_at"),
    )
    nested = (
        candidate_patterns(evidence, active_patterns(rules, patterns), keys, how)
        .groupBy(*keys, "session_start", "rule_id")
        .agg(
            F.max("session_end").alias("session_end"),
            F.max("max_severity").alias("max_severity"),
            F.min("pattern_created_at").alias("first_pattern_at"),
            F.array_sort(F.collect_list(F.when(F.col("pattern_id").isNotNull(), F.struct("pattern_created_at", "pattern_id"))))
            .getField("pattern_id")
            .alias("pattern_ids"),
            F.bool_or("hit").alias("any_hit"),
            F.bool_and("hit").alias("all_hit"),
        )
    )
    return nested.join(wanted, "rule_id", how)


def rule_verdicts(candidates: DataFrame) -> DataFrame:
    """``single`` rules need one hit pattern, all others need every candidate."""
    matched = F.when(F.col("match_type") == MATCH_SINGLE, F.col("any_hit")).otherwise(F.col("all_hit"))
    return candidates.withColumn("matched", F.col("match_type").isNotNull() & F.coalesce(matched, F.lit(False)))


def rule_order(
    priority: Column, rule_created_at: Column, first_pattern_at: Column, rule_id: Column, *carried: Column
) -> Column:
    """Sort key: priority and rule age descending, first pattern ascending, id."""
    return F.struct(
        (-priority).alias("o1"),
        (-F.unix_micros(rule_created_at)).alias("o2"),
        F.unix_micros(first_pattern_at).alias("o3"),
        rule_id.alias("o4"),
        *carried,
    )


def fold_verdicts(verdicts: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """One row per session: hypotheses and advice of its matched rules in order."""
    entry = rule_order(
        F.col("priority"),
        F.col("rule_created_at"),
        F.col("first_pattern_at"),
        F.col("rule_id"),
        F.col("hypothesis_template").alias("hypothesis"),
        F.col("advice").alias("advice"),
    )
    return (
        verdicts.groupBy(*keys, "session_start")
        .agg(
            F.max("session_end").alias("session_end"),
            F.max("max_severity").alias("max_severity"),
            F.array_sort(F.collect_list(F.when(F.col("matched"), entry))).alias("_ordered"),
        )
        .withColumn("hypotheses", F.col("_ordered.hypothesis"))
        .withColumn("advice", F.flatten(F.col("_ordered.advice")))
        .drop("_ordered")
    )


def attach_fallback(folded: DataFrame, error: Column | None = None) -> DataFrame:
    """Finish the analysis: sessions without a match get the fixed fallback.

    The length of the score list is the count before hypotheses are deduplicated.
    """
    source = analysis_source(F.col("hypotheses"))
    texts = F.when(source == RULE_BASED, F.col("hypotheses")).otherwise(fallback_hypotheses())
    advice = F.when(source == RULE_BASED, F.col("advice")).otherwise(fallback_recommendations(error))
    return (
        folded.withColumn("analysis_source", source)
        .withColumn("_texts", texts)
        .withColumn("recommendations", dedupe_strings(advice))
        .withColumn("confidence", confidence_scores(F.size("_texts"), F.col("analysis_source")))
        .withColumn("hypotheses", dedupe_strings(F.col("_texts")))
        .withColumn("analysis_summary", analysis_summary(F.col("hypotheses")))
        .drop("_texts", "advice")
    )


def analyze_evidence(
    evidence: DataFrame, rules: DataFrame, patterns: DataFrame, keys: Sequence[str] = SESSION_KEYS
) -> DataFrame:
    return attach_fallback(fold_verdicts(rule_verdicts(candidate_rules(evidence, rules, patterns, keys, "left")), keys))


def analyze_sessions(
    signals: DataFrame,
    rules: DataFrame,
    patterns: DataFrame,
    window_us: int = DEFAULT_WINDOW_US,
    keys: Sequence[str] = SESSION_KEYS,
    high_only: bool = False,
    enforce_severity_min: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """Sessions with their analysis, in one plan over one scan of the signals."""
    evidence = session_evidence(signals, active_patterns(rules, patterns), window_us, keys, enforce_severity_min, index)
    if high_only:
        evidence = evidence.filter(is_high(F.col("max_severity")))
    return analyze_evidence(evidence, rules, patterns, keys)
