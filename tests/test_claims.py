"""Open incidents as streaming state, against the batch form micro-batch by micro-batch."""

import random

import pytest
from pyspark.sql import functions as F

from pulseloom.operators.incidents import claim_incidents
from pulseloom.schemas import INCIDENTS
from pulseloom.streaming.claims import (
    EVENTS,
    closed_events,
    decided_changes,
    opened_events,
    session_events,
    stream_claims,
    undecided_sessions,
)
from tests.test_incidents import as_of

WINDOW = 60_000_000
SESSIONS = "source string, env string, session_start long, session_end long, max_severity int"
ZERO = 1_704_067_200_000_000


def us(seconds):
    return ZERO + int(seconds * 1e6)


def stamp(seconds):
    return F.timestamp_micros(F.lit(us(seconds)))


def stored(spark, *rows):
    """Incidents of (id, source, updated, status)."""
    frame = spark.createDataFrame(
        [(i, "t", status, 1, [source], ["prod"], "s", ["a"], us(at), us(at)) for i, source, at, status in rows],
        "id string, title string, status string, severity int, impacted_services array<string>, environments array<string>, "
        "analysis_summary string, recommendations array<string>, created_at long, updated_at long",
    )
    return frame.withColumns({c: F.timestamp_micros(c) for c in ("created_at", "updated_at")}).select(*INCIDENTS.names)


def sessions_of(spark, rows):
    return spark.createDataFrame([(s, "prod", us(a), us(b), v) for s, a, b, v in rows], SESSIONS)


def run(spark, base, *events, watermark="1 day"):
    """One more micro-batch, by a query of its own."""
    whole = events[0]
    for more in events[1:]:
        whole = whole.unionByName(more)
    whole.coalesce(1).write.mode("append").parquet(f"{base}/feed")
    feed = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    stream_claims(feed, f"{base}/out", f"{base}/checkpoint", WINDOW, watermark).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_three_micro_batches_decide_as_the_batch_form_does(spark, tmp_path):
    rng = random.Random(7)
    base, known, decided = str(tmp_path), {}, set()
    for number in range(3):
        rows, at = [], number * 3_000
        for n in range(60):
            at += rng.randrange(61, 120)
            rows.append((f"v{n % 3}", at, at + rng.randrange(0, 50), rng.randrange(0, 6)))
        opened = [(f"i{rng.randrange(90)}", f"v{rng.randrange(3)}", rng.randrange(0, 12_000), "new") for _ in range(30)]
        opened = list({o[0]: o for o in opened if known.get(o[0], o)[1] == o[1]}.values())
        gone = [known[i] for i in sorted(known)[:3] if i not in {o[0] for o in opened}]
        known.update({o[0]: o for o in opened})
        for row in gone:
            del known[row[0]]
        sessions = sessions_of(spark, rows)
        claims = {(r.source, r.session_start, r.incident_id) for r in claim_incidents(sessions, stored(spark, *known.values()), WINDOW).collect()}
        events = [opened_events(stored(spark, *opened, ("shut", "v1", 5, "closed")), stamp(at)), session_events(sessions)]
        if gone:
            events.append(closed_events(stored(spark, *gone), stamp(at)))
        out = run(spark, base, *events).collect()
        new = {r for r in out if r.epoch not in decided}
        assert {(r.source, r.session_start, r.incident_id) for r in new if r.outcome == "merged"} == claims and claims
        high = {(s, us(a)) for s, a, _, v in rows if v >= 4}
        free = {(s, us(a)) for s, a, _, _ in rows} - {c[:2] for c in claims}
        assert {(r.source, r.session_start) for r in new if r.outcome == "created"} == free & high
        assert {(r.source, r.session_start) for r in new if r.outcome == "dropped"} == free - high
        decided |= {r.epoch for r in new}
        for claim in claims:
            del known[claim[2]]


def test_claimed_and_reopened_incidents_late_sessions_and_changes(spark, tmp_path):
    base, hour = str(tmp_path), 3_600
    incident = stored(spark, ("i", "v", 100, "new"))
    sessions = sessions_of(spark, [("v", 100, 130, 1), ("v", 300, 310, 5), ("w", 100, 120, 2)])
    first = run(spark, base, opened_events(incident, stamp(0)), session_events(sessions), watermark="1 hour")
    pick = lambda rows: sorted((r.source, (r.session_start - ZERO) // 1_000_000, r.outcome, r.incident_id) for r in rows)
    seen = pick(first.collect())
    assert seen == [("v", 100, "merged", "i"), ("v", 300, "created", None), ("w", 100, "dropped", None)]
    # The merged incident is resolved; somebody opens it again, so the next session finds it.
    again = stored(spark, ("i", "v", 390, "new"), ("old", "v", 391, "new"))
    more = sessions_of(spark, [("v", 400, 440, 0), ("u", 9 * hour, 9 * hour, 0)])
    second = run(spark, base, opened_events(again, stamp(395)), session_events(more), watermark="1 hour").collect()
    assert pick(second) == sorted([*seen, ("v", 400, "merged", "i"), ("u", 9 * hour, "dropped", None)], key=lambda r: r[:2])
    # Now the watermark has left "old" behind, and a session of that time is too late to be decided here.
    late, new = sessions_of(spark, [("v", 500, 510, 4)]), sessions_of(spark, [("v", 10 * hour, 10 * hour, 4)])
    third = run(spark, base, session_events(late), session_events(new), watermark="1 hour")
    assert ("v", 10 * hour, "created", None) in pick(third.collect())
    assert undecided_sessions(sessions.unionByName(more).unionByName(late).unionByName(new), third).collect() == late.collect()

    analyzed = sessions.withColumns({"analysis_summary": F.lit("why"), "recommendations": F.array(F.lit("b"))})
    changes = {r.id: r for r in decided_changes(analyzed, first.where("epoch = 0"), incident, as_of()).collect()}
    assert changes["i"].analysis_summary == "why" and changes["i"].recommendations == ["a", "b"]
    assert sorted((r.severity, r.impacted_services[0]) for r in changes.values()) == [(1, "v"), (5, "v")]


def test_incidents_of_several_keys_are_refused(spark):
    shared = stored(spark, ("i", "v", 0, "new")).withColumn("impacted_services", F.array(F.lit("v"), F.lit("w")))
    assert opened_events(shared.withColumn("status", F.lit("resolved")), stamp(0)).count() == 0
    with pytest.raises(Exception, match="touches several keys"):
        opened_events(shared, stamp(0)).collect()
