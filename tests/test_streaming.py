import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from pulseloom.operators.ingest import classified_signals, valid_signals, validate_signals
from pulseloom.operators.sessions import session_summary
from pulseloom.schemas import INCIDENTS, PATTERNS, RULES, SIGNALS
from pulseloom.sources.envelopes import envelope_signals, parse_envelopes
from pulseloom.sources.signal_store import SignalStore
from pulseloom.sources.store import append_signals, expire_signals, read_table
from pulseloom.sources.tables import sample_patterns, sample_rules
from pulseloom.streaming.ingest import correlate_epoch, ingest_epoch, stream_incidents, stream_ingest
from pulseloom.streaming.metrics import OutcomeListener, observe_outcomes, read_counts, rolling_counts, stream_counts
from pulseloom.streaming.sessions import repair_sessions, repaired_sessions, stream_sessions, unsessioned_signals
from tests.test_rules import T0, pattern, rule, signal


def envelope(*signals):
    return json.dumps({"signals": list(signals)})


def item(id_, at, severity=5, source="svc", **extra):
    when = (T0 + dt.timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": id_, "eventType": "log", "source": source, "environment": "prod", "severity": severity, "timestamp": when, "message": "timeout", **extra}


def envelope_stream(spark, folder):
    texts = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    return envelope_signals(parse_envelopes(texts.select(F.sha2("value", 256).alias("batch_id"), "value")))


def write(folder, number, *signals):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text(envelope(*signals) + "\n")
    os.utime(path, (1_000_000 + number, 1_000_000 + number))  # files are read by age


def test_ingest_stream_stores_each_id_once_and_late_rows_too(spark, tmp_path):
    feed, base = tmp_path / "feed", str(tmp_path / "base")
    write(feed, 1, item("a", 0), item("b", 5), item("bad", 6, severity=9))
    write(feed, 2, item("a", 0), item("late", -86_400))
    for _ in range(2):  # a restart finds nothing left to do
        stream_ingest(envelope_stream(spark, str(feed)), base, f"{base}/ckpt").awaitTermination()
    write(feed, 3, item("b", 5), item("c", 700))
    stream_ingest(envelope_stream(spark, str(feed)), base, f"{base}/ckpt").awaitTermination()
    assert sorted(r.id for r in SignalStore(spark, f"{base}/signals").read().collect()) == ["a", "b", "c", "late"]
    totals = spark.read.parquet(f"{base}/metrics").agg(
        F.sum("accepted_count"), F.sum("duplicate_count"), F.sum("rejected_count")
    ).first()
    assert tuple(totals) == (4, 2, 1)


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "base")
    texts = spark.createDataFrame([(1, envelope(item("a", 0), item("b", 5), {**item("n", 9), "timestamp": ""}))], "batch_id int, value string")
    raw = envelope_signals(parse_envelopes(texts))
    rules, patterns = spark.createDataFrame([rule("r")], RULES), spark.createDataFrame([pattern("p", "r", text="timeout", env="production")], PATTERNS)
    seen = []
    for _ in range(2):
        accepted = ingest_epoch(raw, 7, base).accepted
        correlate_epoch(accepted, 7, base, rules, patterns)
        tables = [SignalStore(spark, f"{base}/signals").read().collect(), *[spark.read.parquet(f"{base}/{t}").collect() for t in ("incidents", "links", "metrics")]]
        seen.append([sorted(map(repr, rows)) for rows in tables])
    assert seen[0] == seen[1]
    assert [len(rows) for rows in seen[0]] == [3, 2, 3, 1]


def test_incident_stream_relates_later_batches_through_open_incidents(spark, tmp_path):
    feed, base = tmp_path / "feed", str(tmp_path / "base")
    rules, patterns = spark.createDataFrame([rule("r")], RULES), spark.createDataFrame([pattern("p", "r", text="timeout", env="production")], PATTERNS)
    write(feed, 1, item("a", 0), item("b", 30))
    stream_incidents(envelope_stream(spark, str(feed)), base, f"{base}/ckpt", rules, patterns).awaitTermination()
    first = read_table(spark, f"{base}/incidents", INCIDENTS).select(INCIDENTS.names).collect()
    assert [(r.status, r.analysis_summary) for r in first] == [("resolved", "because r")]
    # Somebody opens it again; the next low session then enriches it.
    reopened = spark.createDataFrame(first, INCIDENTS).withColumn("status", F.lit("new")).withColumn("created_on", F.to_date("created_at"))
    reopened.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_on").parquet(f"{base}/incidents")
    write(feed, 2, item("c", 100, severity=1))
    stream_incidents(envelope_stream(spark, str(feed)), base, f"{base}/ckpt", rules, patterns).awaitTermination()
    second = read_table(spark, f"{base}/incidents", INCIDENTS).collect()
    assert len(second) == 1 and second[0].created_at == first[0].created_at
    assert second[0].recommendations == first[0].recommendations * 2
    links = spark.read.parquet(f"{base}/links").select("incident_id", "signal_id").collect()
    assert sorted(tuple(r) for r in links) == [(first[0].id, i) for i in ("a", "b", "c")]


def rows_of(signals):
    return [(s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7], s[8]) for s in signals]


def run_sessions(spark, feed, base):
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).json(str(feed))
    query = (
        stream_sessions(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_stream_sessions_equal_batch_sessions_and_late_ones_are_repaired(spark, tmp_path):
    feed, base = tmp_path / "feed", str(tmp_path / "base")
    feed.mkdir()
    signals = [signal(f"s{n}", "m", at=n * 37 + (n % 11) * 5, source=f"v{n % 3}", severity=n % 6) for n in range(240)]
    files = [signals[:120], signals[120:], signals[:10], [signal("late", "m", at=-80_000, source="v0")]]
    for number, part in enumerate(files):
        lines = [
            json.dumps({"id": s[0], "event_type": s[1], "source": s[2], "env": s[3], "timestamp": s[4].isoformat(), "severity": s[5], "message": s[6]})
            for s in part
        ]
        path = feed / f"{number:03d}.json"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_000_000 + number, 1_000_000 + number))  # files are read by age
    emitted = run_sessions(spark, feed, base)
    batch = session_summary(spark.createDataFrame(rows_of(signals), SIGNALS))
    closed_before = int((signals[-1][4] - dt.timedelta(minutes=12)).timestamp() * 1e6)
    columns = ["source", "env", "session_start", "session_end", "signal_count", "max_severity"]
    got = {tuple(r) for r in emitted.select(columns).collect()}
    want = {tuple(r) for r in batch.select(columns).collect()}
    assert got <= want
    assert {r for r in want if r[3] < closed_before} <= got

    stored = spark.createDataFrame(rows_of([*signals, signal("late", "m", at=-80_000, source="v0")]), SIGNALS)
    missing = {r.id for r in unsessioned_signals(stored, emitted).collect()}
    assert "late" in missing
    repaired = {tuple(r) for r in repaired_sessions(stored, emitted).select(columns).collect()}
    assert {r for r in repaired if r[0] == "v0"} == {tuple(r) for r in session_summary(stored).filter("source = 'v0'").select(columns).collect()}


def test_late_signals_change_only_what_they_reach(spark):
    rng = random.Random(4)
    rows = [signal(f"s{n}", "m", at=rng.randrange(0, 40 * 86_400), source=f"v{n % 3}", severity=n % 6) for n in range(1_500)]
    rows += [signal(f"d{n}", "m", at=9 * 86_400 + n * 45, source="v0") for n in range(300)]  # a session of hours
    on_time = [s for s in rows if not (9 * 86_400 <= int((s[4] - T0).total_seconds()) < 9.3 * 86_400 and int(s[0][1:]) % 3 == 0)]
    late = [s for s in rows if s not in on_time]
    emitted = session_summary(spark.createDataFrame(on_time, SIGNALS))
    missed = unsessioned_signals(spark.createDataFrame(late, SIGNALS), emitted)
    repair = repair_sessions(missed, emitted)
    columns = ["source", "env", "session_start", "session_end"]
    key = lambda frame: {tuple(r) for r in frame.select(columns).collect()}
    whole = key(session_summary(spark.createDataFrame(rows, SIGNALS)))
    assert (key(emitted) - key(repair.retracted)) | key(repair.repaired) == whole
    assert key(repair.retracted) <= key(emitted) and not key(repair.repaired) & (key(emitted) - key(repair.retracted))
    first, last = (int((T0 + dt.timedelta(days=d)).timestamp() * 1e6) for d in (8.9, 9.4))
    assert all(first < r[2] and r[3] < last for r in key(repair.retracted))
    none = repair_sessions(missed.limit(0), emitted)
    assert none.retracted.count() == none.repaired.count() == 0


def test_observed_outcomes(spark, tmp_path):
    feed = tmp_path / "feed"
    write(feed, 1, item("a", 0), item("a", 0), item("x", 1, severity=8))
    listener = OutcomeListener()
    spark.streams.addListener(listener)
    try:
        def run(batch, _):
            validated = validate_signals(batch, F.current_timestamp())
            assert valid_signals(validated).count() == 2
            classified_signals(validated).write.format("noop").mode("overwrite").save()

        outcomes = envelope_stream(spark, str(feed)).select(
            F.when(F.col("severity") > 5, F.lit("rejected")).otherwise(F.lit("accepted")).alias("outcome")
        )
        envelope_stream(spark, str(feed)).writeStream.foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
        query = observe_outcomes(outcomes).writeStream.format("noop").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if listener.totals["accepted"]:
                break
            import time

            time.sleep(0.1)
        assert listener.totals == {"accepted": 2, "duplicate": 0, "rejected": 1}
    finally:
        spark.streams.removeListener(listener)


def test_live_counters_follow_late_and_repeated_epochs(spark, tmp_path):
    base = str(tmp_path / "base")
    zone = dt.timezone.utc
    assert read_counts(spark, base).count() == 0
    epochs = [(0, 5, ["a", "b"]), (1, 70, ["c", "a"]), (1, 70, ["c", "a"]), (2, 200, ["d"]), (3, 30, ["e", "e", "f"])]
    for epoch, minutes, ids in epochs:
        texts = spark.createDataFrame([(epoch, envelope(*[item(i, 0) for i in ids], item("bad", 0, severity=9)))], "batch_id int, value string")
        raw = envelope_signals(parse_envelopes(texts))
        ingest_epoch(raw, epoch, base, now=dt.datetime(2024, 1, 1, tzinfo=zone) + dt.timedelta(minutes=minutes))
        stream_counts(spark, base, f"{base}/counting").awaitTermination()
        live = {tuple(r) for r in read_counts(spark, base).collect()}
        assert live == {tuple(r) for r in rolling_counts(spark.read.parquet(f"{base}/metrics")).collect()}
    # Two epochs in the first hour: a and b, then e and f with a repeat.
    assert {(r.window_start.hour, r.accepted_count, r.duplicate_count, r.rejected_count) for r in read_counts(spark, base).collect()} == {
        (0, 4, 1, 2), (1, 1, 1, 1), (3, 1, 0, 1)
    }


def test_expiry_rewrites_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "signals")
    day = 86_400
    rows = [signal("gone", "m", at=-9 * day), signal("gone2", "m", at=-7 * day - 60), signal("kept", "m", at=-7 * day + 60), signal("new", "m", at=0)]
    append_signals(spark.createDataFrame(rows, SIGNALS), path, 1)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "signals").rglob("dt=2024-01-01/**/*.parquet")}
    expire_signals(spark, path, SIGNALS, F.lit("dev"), F.lit(T0))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["kept", "new"]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "signals").rglob("dt=2024-01-01/**/*.parquet")} == untouched
    assert untouched


def test_sample_tables(spark):
    assert sample_rules(spark).count() == 4
    assert {r.id: r.message_regex is not None for r in sample_patterns(spark).collect()}["p1"]
