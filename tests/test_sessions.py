import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import sessions as ses
from pulseloom.schemas import SIGNALS
from tests.plain import session_windows, sessionize_by_lag

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def make(spark, rows):
    """rows: (id, source, env, seconds after T0, severity)"""
    full = [
        (i, "log", source, env, T0 + dt.timedelta(microseconds=round(at * 1e6)), severity, "m", "{}", {})
        for i, source, env, at, severity in rows
    ]
    return spark.createDataFrame(full, SIGNALS)


def members(frame):
    return {r.id: (r.source, r.env, r.session_start) for r in frame.collect()}


def test_reference_case(spark):
    rows = [("a1", "svc-a", "prod", 0, 2), ("a2", "svc-a", "prod", 10, 2), ("a3", "svc-a", "prod", 120, 4), ("b1", "svc-b", "prod", 5, 3)]
    sessions = ses.session_summary(make(spark, rows), 30_000_000)
    assert sessions.count() == 3
    high = ses.high_severity_sessions(sessions).collect()
    assert [(r.source, r.signal_count) for r in high] == [("svc-a", 1)]


def test_pause_of_exactly_the_window_stays_together(spark):
    assert ses.session_summary(make(spark, [("a", "s", "e", 0, 1), ("b", "s", "e", 60, 1)])).count() == 1
    assert ses.session_summary(make(spark, [("a", "s", "e", 0, 1), ("b", "s", "e", 60.000001, 1)])).count() == 2


def test_bar_in_source_does_not_mix_keys(spark):
    assert ses.session_summary(make(spark, [("a", "x|y", "z", 0, 1), ("b", "x", "y|z", 0, 1)])).count() == 2


def test_negative_severity_floors_at_zero_and_old_times_work(spark):
    row = ses.session_summary(make(spark, [("a", "s", "e", -2_000_000_000, -3)])).first()
    assert row.max_severity == 0 and row.session_start < 0


@pytest.mark.parametrize("bucket", [1, 7_000_000, 60_000_000, 3_600_000_000])
def test_sessions_across_many_buckets(spark, bucket):
    """One hot key; sessions inside a bucket, across two, and across hundreds; cells finer and coarser than buckets."""
    rng, at, rows = random.Random(3), 0.0, []
    for n in range(1_500):
        at += rng.choice([0, 0.5, 20, 59.999999, 60, 60.000001, 61, 61, 400, 9_000]) if n < 700 else 60
        rows.append((f"h{n}", "hot", "production", at, n % 6))
    rows += [(f"o{n}", f"s{n % 9}", "staging", rng.uniform(0, 20_000), 1) for n in range(500)]
    rows += [(f"n{n}", None, "staging", 70.0 * (n // 2), 1) for n in range(20)]
    signals = make(spark, rows)
    for window in (0, 1_000_000, 60_000_000):
        marked = ses.session_cells(signals, window, bucket_us=max(bucket, window, 1)).groupBy("source", "env", "session_start").agg(F.sum("signal_count").alias("n"))
        plain = sessionize_by_lag(signals, window).groupBy("source", "env", "session_start").count()
        assert sorted(map(tuple, marked.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_members_of_known_sessions(spark):
    rng = random.Random(5)
    signals = make(spark, [(f"id-{n}", f"s{n % 3}", "e", rng.uniform(0, 4_000), 1) for n in range(400)])
    for window in (0, 7_000_000, 60_000_000):
        sessions = ses.session_summary(signals, window).select("source", "env", "session_start", "session_end")
        assert members(ses.members_of(signals, sessions, window)) == members(sessionize_by_lag(signals, window))


def test_no_window_over_all_cells_of_a_key(spark):
    """The scan over cells is cut by bucket; the scan per key sees one row per bucket."""
    signals = make(spark, [(f"id-{n}", "hot", "e", n * 5.0, 1) for n in range(2_000)])
    text = ses.session_cells(signals, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("cell" not in line or "_bucket" in line.split("],", 1)[-1] for line in windows if "lag(" not in line and "carried" not in line)


def test_cells_agree_with_the_plain_window_under_skew(spark):
    rng = random.Random(7)
    rows = []
    for n in range(6_000):
        hot = n % 3 != 0
        source = "hot" if hot else f"s{rng.randrange(40)}"
        at = rng.choice([rng.uniform(-50_000, 90_000), rng.uniform(0, 30), 1_000.0])
        rows.append((f"id-{n}", source, "production", at, rng.randrange(6)))
    rng.shuffle(rows)
    signals = make(spark, rows)
    for window in (0, 1, 1_000_000, 60_000_000, 3_600_000_000):
        assert members(ses.session_members(signals, window)) == members(sessionize_by_lag(signals, window))


def test_positions_and_pages_of_a_hot_group(spark):
    rows = [(f"id-{n:05d}", "hot" if n < 3_000 else f"s{n % 9}", "e", 5.0 if n % 2 else n / 100, 1) for n in range(4_500)]
    random.Random(3).shuffle(rows)
    signals = make(spark, rows)
    placed = ses.add_position(signals.select("id", "source", F.unix_micros("timestamp").alias("ts_us")), ["source"], ["ts_us", "id"])
    found = {}
    for r in placed.collect():
        found.setdefault(r.source, []).append((r.position, r.ts_us, r.id))
    for items in found.values():
        items.sort()
        assert [i[0] for i in items] == list(range(len(items)))
        assert [i[1:] for i in items] == sorted(i[1:] for i in items)
    pages = ses.session_signal_ids(signals, page_rows=50).collect()
    assert max(len(p["values"]) for p in pages) == 50
    assert sum(len(p["values"]) for p in pages) == 4_500


def test_batches_stay_apart_when_asked(spark):
    signals = make(spark, [("a", "s", "e", 0, 1), ("b", "s", "e", 1, 1)]).withColumn("batch_id", F.col("id"))
    assert ses.session_summary(signals, keys=("batch_id", "source", "env")).count() == 2


@pytest.mark.parametrize("bucket", [1, 7_000_000, 60_000_000, 3_600_000_000])
def test_sessions_across_many_buckets(spark, bucket):
    """One hot key; sessions inside a bucket, across two, and across hundreds; cells finer and coarser than buckets."""
    rng, at, rows = random.Random(3), 0.0, []
    for n in range(1_500):
        at += rng.choice([0, 0.5, 20, 59.999999, 60, 60.000001, 61, 61, 400, 9_000]) if n < 700 else 60
        rows.append((f"h{n}", "hot", "production", at, n % 6))
    rows += [(f"o{n}", f"s{n % 9}", "staging", rng.uniform(0, 20_000), 1) for n in range(500)]
    rows += [(f"n{n}", None, "staging", 70.0 * (n // 2), 1) for n in range(20)]
    signals = make(spark, rows)
    for window in (0, 1_000_000, 60_000_000):
        marked = ses.session_cells(signals, window, bucket_us=max(bucket, window, 1)).groupBy("source", "env", "session_start").agg(F.sum("signal_count").alias("n"))
        plain = sessionize_by_lag(signals, window).groupBy("source", "env", "session_start").count()
        assert sorted(map(tuple, marked.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_members_of_known_sessions(spark):
    rng = random.Random(5)
    signals = make(spark, [(f"id-{n}", f"s{n % 3}", "e", rng.uniform(0, 4_000), 1) for n in range(400)])
    for window in (0, 7_000_000, 60_000_000):
        sessions = ses.session_summary(signals, window).select("source", "env", "session_start", "session_end")
        assert members(ses.members_of(signals, sessions, window)) == members(sessionize_by_lag(signals, window))


def test_no_window_over_all_cells_of_a_key(spark):
    """The scan over cells is cut by bucket; the scan per key sees one row per bucket."""
    signals = make(spark, [(f"id-{n}", "hot", "e", n * 5.0, 1) for n in range(2_000)])
    text = ses.session_cells(signals, 1_000_000)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("cell" not in line or "_bucket" in line.split("],", 1)[-1] for line in windows if "lag(" not in line and "carried" not in line)


def test_cells_agree_with_session_windows(spark):
    rng = random.Random(9)
    signals = make(spark, [(f"id-{n}", f"s{n % 3}", "e", rng.uniform(0, 9_000), 1) for n in range(500)])
    mine = session_summary_rows(ses.session_summary(signals))
    assert mine == session_summary_rows(session_windows(signals, ses.DEFAULT_WINDOW_US))


def session_summary_rows(frame):
    return {tuple(r) for r in frame.select("source", "env", "session_start", "signal_count").collect()}
