"""Sessions to incidents: analyse, merge into open incidents, create new ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.analysis import HYBRID, analysis_summary, confidence_scores
from pulseloom.functions.text import sanitize_message
from pulseloom.operators.incidents import (
    TITLE,
    claim_incidents,
    create_incidents,
    merge_incidents,
    session_incident_id,
    union_incident_signals,
)
from pulseloom.operators.rules import analyze_sessions
from pulseloom.operators.sessions import DEFAULT_WINDOW_US, PAGE_ROWS, SESSION_KEYS, is_high, members_of
from pulseloom.operators.suggest import (
    DEFAULT_INSTRUCTIONS,
    PageSuggester,
    Suggester,
    ask_suggester,
    attach_suggestions,
    prompt_parts,
)
from pulseloom.session import checkpointed

# An analyzer turns (signals, rules, patterns, window_us) into one row per
# session with analysis_summary and recommendations; analyze_sessions is one.
Analyzer = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


@dataclass
class Correlated:
    created: DataFrame
    merged: DataFrame
    links: DataFrame  # incident_id, timestamp, signal_id

    @property
    def changes(self) -> DataFrame:
        return self.merged.unionByName(self.created)


def correlate(
    signals: DataFrame,
    incidents: DataFrame,
    rules: DataFrame,
    patterns: DataFrame,
    as_of: Column,
    window_us: int = DEFAULT_WINDOW_US,
    analyzer: Analyzer = analyze_sessions,
    known_links: DataFrame | None = None,
) -> Correlated:
    """Every session looks for an open incident first. Without one a session of
    high severity becomes an incident and any other is dropped.

    The analysis and the claims are fixed once (one row per session or less);
    all branches read them. With ``known_links`` (incident_id, signal_id), links
    an incident has already are left out.
    """
    analyzed = checkpointed(analyzer(signals, rules, patterns, window_us))
    session = [*SESSION_KEYS, "session_start"]
    claims = checkpointed(claim_incidents(analyzed.select(*session, "session_end"), incidents, window_us))
    fresh = analyzed.join(claims, session, "left_anti")
    owners = claims.unionByName(
        fresh.filter(is_high(F.col("max_severity"))).select(*session, session_incident_id(as_of).alias("incident_id"))
    )
    owned = analyzed.select(*session, "session_end").join(owners, session)
    links = (
        members_of(signals, owned, window_us)
        .select("incident_id", as_of.alias("added_at"), "timestamp", F.col("id").alias("signal_id"))
    )
    if known_links is not None:
        links = union_incident_signals(known_links, links)
    return Correlated(create_incidents(fresh, as_of), merge_incidents(analyzed, claims, incidents, as_of), links)


def suggested_analysis(
    suggester: Suggester | PageSuggester,
    as_of: Column,
    instructions: str = DEFAULT_INSTRUCTIONS,
    page_rows: int = PAGE_ROWS,
    ask: Callable[..., DataFrame] = ask_suggester,
) -> Analyzer:
    """An analyzer that asks ``suggester`` about every session no rule matches.

    Its whole prompt holds the session's signals in order, messages sanitised. A
    usable answer replaces the fallback; otherwise the fallback names the error.
    With ``ask=ask_by_pages`` the suggester gets each prompt as an iterator.
    """

    def analyze(signals: DataFrame, rules: DataFrame, patterns: DataFrame, window_us: int) -> DataFrame:
        rows = checkpointed(analyze_sessions(signals, rules, patterns, window_us))
        session = [*SESSION_KEYS, "session_start"]
        unmatched = rows.filter(F.col("analysis_source") == HYBRID).withColumn("id", session_incident_id(as_of))
        incidents = unmatched.select(
            "id",
            F.lit(TITLE).alias("title"),
            F.lit("in-progress").alias("status"),
            F.col("max_severity").alias("severity"),
            F.array("source").alias("impacted_services"),
            F.array("env").alias("environments"),
            F.lit("").alias("analysis_summary"),
            F.array().cast("array<string>").alias("recommendations"),
        )
        evidence = members_of(signals, unmatched.select(*session, "session_end", F.col("id").alias("incident_id")), window_us).select(
            "incident_id", F.col("id").alias("signal_id"), "event_type", "source", "env", "severity", "timestamp",
            sanitize_message(F.col("message")).alias("message"),
        )
        answers = checkpointed(ask(prompt_parts(incidents, evidence, page_rows), suggester, instructions))
        found = attach_suggestions(unmatched, answers).select(
            F.col("id").alias("_id"), F.col("hypotheses").alias("_hypotheses"), F.col("recommendations").alias("_advice")
        )
        placed = unmatched.select(*session, F.col("id").alias("_id")).join(found, "_id").drop("_id")
        return (
            rows.join(placed, session, "left")
            .withColumn("hypotheses", F.coalesce("_hypotheses", "hypotheses"))
            .withColumn("recommendations", F.coalesce("_advice", "recommendations"))
            .withColumn("confidence", confidence_scores(F.size("hypotheses"), F.col("analysis_source")))
            .withColumn("analysis_summary", analysis_summary(F.col("hypotheses")))
            .select(*rows.columns)
        )

    return analyze
