"""Scalar functions of the analysis step and of incident rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseloom.functions.text import environment_key

# Scores and texts that appear in results.
RULE_BASED = "rule-based"
HYBRID = "hybrid"
RULE_BASE_SCORE = 0.83
HYBRID_BASE_SCORE = 0.62
SCORE_STEP = 0.07
SCORE_FLOOR = 0.4
FALLBACK_HYPOTHESIS = "insufficient deterministic evidence"
FALLBACK_RECOMMENDATIONS = (
    "Collect additional traces and infrastructure metrics for this window.",
    "Escalate to hybrid analysis with service owner context.",
)
CLOSED_STATUSES = ("resolved", "closed", "in-progress")
HIGH_SEVERITY = 4
RETENTION_DAYS = {
    # environment: (signals, incidents)
    "production": (30, 365),
    "staging": (14, 90),
    "other": (7, 30),
}


def confidence_scores(count: Column, source: Column) -> Column:
    base = F.when(source == RULE_BASED, F.lit(RULE_BASE_SCORE)).otherwise(F.lit(HYBRID_BASE_SCORE))
    last = F.greatest(count.cast("int"), F.lit(1)) - 1
    scores = F.transform(F.sequence(F.lit(0), last), lambda i: F.greatest(F.lit(SCORE_FLOOR), base - F.lit(SCORE_STEP) * i))
    return F.when(count > 0, scores)


def analysis_source(hypotheses: Column) -> Column:
    return F.when(F.coalesce(F.size(hypotheses), F.lit(0)) > 0, F.lit(RULE_BASED)).otherwise(F.lit(HYBRID))


def dedupe_strings(values: Column) -> Column:
    """Distinct values in first-seen order; an empty list becomes null."""
    return F.when(F.size(values) > 0, F.array_distinct(values))


def union_signal_ids(base: Column, extra: Column) -> Column:
    """``base`` as it is, then the ids of ``extra`` it lacks, each once."""
    kept = F.coalesce(base, F.array().cast("array<string>"))
    return F.concat(kept, F.array_except(F.coalesce(extra, F.array().cast("array<string>")), kept))


def append_recommendations(base: Column, extra: Column) -> Column:
    """Plain concatenation: repeated merges may repeat a recommendation."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(base, none), F.coalesce(extra, none))


def analysis_summary(hypotheses: Column) -> Column:
    return F.array_join(hypotheses, "; ")


def fallback_hypotheses() -> Column:
    return F.array(F.lit(FALLBACK_HYPOTHESIS))


def fallback_recommendations(error: Column | None = None) -> Column:
    """The two fixed recommendations, then the error text if there is one."""
    fixed = [F.lit(text) for text in FALLBACK_RECOMMENDATIONS]
    return F.array(*fixed) if error is None else F.array_compact(F.array(*fixed, error))


def is_open(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*CLOSED_STATUSES)


def max_severity(severity: Column) -> Column:
    """Largest severity of a group, never below zero (aggregate)."""
    return F.greatest(F.lit(0), F.coalesce(F.max(severity), F.lit(0)))


def retention_profile(env: Column) -> Column:
    """(raw_days, incident_days) of an environment; unknown ones get the shortest."""
    key = environment_key(env)

    def days(position: int) -> Column:
        return (
            F.when(key.isin("prod", "production"), F.lit(RETENTION_DAYS["production"][position]))
            .when(key.isin("staging", "stage"), F.lit(RETENTION_DAYS["staging"][position]))
            .otherwise(F.lit(RETENTION_DAYS["other"][position]))
        )

    return F.struct(days(0).alias("raw_days"), days(1).alias("incident_days"))
