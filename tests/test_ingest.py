import json

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import ingest as ing
from pulseloom.plans.ingest import ingest
from pulseloom.sources.envelopes import envelope_signals, parse_envelopes, quarantined_batches, read_envelopes


def as_of():
    return F.timestamp_micros(F.lit(1_706_745_600_000_000))



def batch(*signals, environment="prod"):
    return json.dumps({"sourceContext": "local", "signals": [{"environment": environment, **s} if environment else s for s in signals]})


def parsed(spark, *texts):
    return parse_envelopes(spark.createDataFrame(list(enumerate(texts)), "batch_id long, value string"))


def outcome(spark, text):
    validated = ing.validate_signals(envelope_signals(parsed(spark, text)), as_of())
    errors = [r.error for r in ing.rejected_errors(validated).orderBy("pos", "error_pos").collect()]
    return validated.filter("is_valid").count(), errors


GOOD = {"eventType": "log", "source": "svc", "severity": 5}


@pytest.mark.parametrize(
    ("signal", "errors"),
    [
        (GOOD, []),
        ({**GOOD, "eventType": "deployment", "severity": 0}, []),
        ({**GOOD, "eventType": "health", "severity": 3}, []),
        ({**GOOD, "eventType": "oops"}, ["invalid eventType"]),
        ({**GOOD, "eventType": "Log"}, ["invalid eventType"]),
        ({**GOOD, "severity": -1}, ["invalid severity"]),
        ({**GOOD, "severity": 6}, ["invalid severity"]),
        ({"eventType": "log", "source": "svc"}, ["missing severity"]),
        ({**GOOD, "timestamp": "not-a-time"}, ["invalid timestamp"]),
        ({**GOOD, "timestamp": ""}, []),
        ({"eventType": "log", "severity": 2}, ["missing source"]),
        (
            {"eventType": "bad", "source": "svc", "severity": 9, "timestamp": "bad-time"},
            ["invalid eventType", "invalid severity", "invalid timestamp"],
        ),
        ({}, ["missing eventType", "missing source", "missing severity"]),
    ],
)
def test_validation(spark, signal, errors):
    valid, found = outcome(spark, batch(signal))
    assert found == [f"signal 0: {e}" for e in errors]
    assert valid == (0 if errors else 1)


def test_missing_environment_is_an_error(spark):
    assert outcome(spark, batch(GOOD, environment=None)) == (0, ["signal 0: invalid environment: "])


def test_bad_batches_are_refused_as_a_whole(spark):
    texts = ["{", '{"signals":[]}', '{"sourceContext":"x"}', batch({**GOOD, "severity": "high"}), batch({**GOOD, "severity": 1.5}), batch(GOOD)]
    frame = parsed(spark, *texts)
    assert {r.batch_id for r in quarantined_batches(frame).collect()} == {0, 1, 2, 3, 4}
    assert [r.batch_id for r in envelope_signals(frame).collect()] == [5]


def test_wrong_types_and_trailing_text_refuse_the_batch(spark):
    wrong = [{"source": 5}, {"message": True}, {"environment": {"a": 1}}, {"metadata": {"a": 1}}, {"id": ["x"]}]
    frame = parsed(spark, *[batch({**GOOD, **w}) for w in wrong], batch(GOOD) + " tail", batch(GOOD) + batch(GOOD), batch({**GOOD, "message": None}) + "\n")
    assert {r.batch_id for r in quarantined_batches(frame).collect()} == set(range(7))
    assert [r.batch_id for r in envelope_signals(frame).collect()] == [7]


def test_a_repeated_line_is_a_duplicate(spark, tmp_path):
    line = batch({**GOOD, "id": "x1"}) + "\n"
    (tmp_path / "a.json").write_text(line * 3)
    result = ingest(envelope_signals(read_envelopes(spark, str(tmp_path))), as_of())
    assert result.accepted.count() == 1
    counts = [(r.accepted_count, r.duplicate_count) for r in result.summary.orderBy("batch_id").collect()]
    assert counts == [(1, 0), (0, 1), (0, 1)]


def test_payload_keeps_its_types_and_metadata(spark):
    row = envelope_signals(parsed(spark, batch({**GOOD, "payload": {"a": 1, "b": "1", "c": None}, "metadata": {"m": "n"}}))).first()
    assert json.loads(row.payload) == {"a": 1, "b": "1", "c": None}
    assert row.metadata == {"m": "n"}


def test_read_envelopes_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(batch(GOOD) + "\n" + batch(GOOD, GOOD) + "\n")
    (tmp_path / "b.json").write_text("{\n")
    assert envelope_signals(read_envelopes(spark, str(tmp_path))).count() == 3
    assert quarantined_batches(read_envelopes(spark, str(tmp_path))).count() == 1
    (tmp_path / "a.json").write_text(json.dumps(json.loads(batch(GOOD)), indent=2))
    assert envelope_signals(read_envelopes(spark, str(tmp_path), whole_files=True)).count() == 1


@pytest.mark.parametrize("whole", [False, True])
def test_batch_ids_do_not_depend_on_the_split(spark, tmp_path, whole):
    """Equal lines get different ids, and every line the same one however files are cut and packed into tasks."""
    for name in ("a", "b"):
        (tmp_path / name).write_text("".join(batch({**GOOD, "message": "m" * (n % 7 * 40)}) + "\n" for n in range(40)) + batch(GOOD))
    seen = []
    try:
        for size, cores in (("128m", "1"), ("700", "3"), ("3k", "1"), ("64", "8")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            spark.conf.set("spark.sql.files.minPartitionNum", cores)
            seen.append(sorted((r.batch_id, r.value) for r in read_envelopes(spark, str(tmp_path), whole_files=whole).collect()))
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert all(rows == seen[0] for rows in seen) and len({i for i, _ in seen[0]}) == len(seen[0]) == (2 if whole else 82)
    if not whole:
        assert [i.split("#")[1] for i, _ in seen[0][:41]] == [f"{n:012d}" for n in range(41)]


def test_duplicates_and_summary(spark):
    texts = [batch({**GOOD, "id": "a"}, {**GOOD, "id": "a"}, {**GOOD, "id": "s"}, {**GOOD, "severity": 7}), batch({**GOOD, "id": "a"})]
    stored = spark.createDataFrame([("s",)], "id string")
    result = ingest(envelope_signals(parsed(spark, *texts)), as_of(), stored)
    rows = {r.batch_id: r for r in result.summary.collect()}
    assert (rows[0].accepted_count, rows[0].duplicate_count, rows[0].rejected_count) == (1, 2, 1)
    assert (rows[1].accepted_count, rows[1].duplicate_count, rows[1].ingestion_id) == (0, 1, "")
    assert [(r.batch_id, r.pos) for r in result.accepted.collect()] == [(0, 0)]


def test_invalid_first_row_does_not_make_a_duplicate(spark):
    result = ingest(envelope_signals(parsed(spark, batch({**GOOD, "id": "a", "severity": 9}, {**GOOD, "id": "a"}))), as_of())
    assert [r.pos for r in result.accepted.collect()] == [1]


def test_store_gets_masked_text_and_job_gets_raw_text(spark):
    signal = {**GOOD, "message": "password=x", "payload": {"keep": 1, "drop": 2}}
    result = ingest(envelope_signals(parsed(spark, batch(signal))), as_of(), allow_list=F.array(F.lit("keep")))
    assert result.accepted.first().message == "password=x"
    kept = result.stored.first()
    assert (kept.message, kept.payload) == ("password=[REDACTED]", '{"keep":1}')


def test_default_ids_are_repeatable(spark):
    frame = envelope_signals(parsed(spark, batch(GOOD, GOOD)))
    first = [r.id for r in ing.validate_signals(frame, as_of()).orderBy("pos").collect()]
    assert first == [r.id for r in ing.validate_signals(frame, as_of()).orderBy("pos").collect()]
    assert len(set(first)) == 2


def test_error_pages_hold_every_error(spark):
    text = batch(*[{**GOOD, "severity": 9} for _ in range(7)])
    pages = ing.error_pages(ing.validate_signals(envelope_signals(parsed(spark, text)), as_of()), page_rows=3).orderBy("page").collect()
    assert [len(p["values"]) for p in pages] == [3, 3, 1]
    assert [v for p in pages for v in p["values"]] == [f"signal {i}: invalid severity" for i in range(7)]


def test_upsert_signals_last_write_wins(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "id string, severity int")
    incoming = spark.createDataFrame([("a", 2, 0, 0), ("a", 3, 0, 1), ("c", 4, 1, 0)], "id string, severity int, batch_id int, pos int")
    assert {tuple(r) for r in ing.upsert_signals(stored, incoming).collect()} == {("a", 3), ("b", 1), ("c", 4)}


def test_blank_and_unset_times_become_now(spark):
    signals = [{**GOOD, "timestamp": t} for t in ("", "0001-01-01T00:00:00Z", "2024-01-01T00:00:00Z")]
    rows = ing.validate_signals(envelope_signals(parsed(spark, batch(*signals))), as_of()).orderBy("pos")
    times = [r.us for r in rows.select("pos", F.unix_micros("timestamp").alias("us")).collect()]
    assert times == [1_706_745_600_000_000, 1_706_745_600_000_000, 1_704_067_200_000_000]


def test_a_fixed_ingest_checks_its_rows_once(spark):
    from pyspark.sql import functions as F

    from pulseloom.plans import ingest as plan

    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(kind):
        looked.add(1)
        return kind

    rows = [(1, n, f"a{n % 8}", "log" if n < 9 else "oops", "svc", "prod", "2024-01-01T00:00:00Z", 1, "m", "{}", {}) for n in range(12)]
    columns = "batch_id long, pos int, id string, event_type string, source string, environment string, timestamp string, severity int, message string, payload string, metadata map<string,string>"
    raw = spark.createDataFrame(rows, columns).withColumn("event_type", noted("event_type"))
    stored = spark.createDataFrame([("a3",)], "id string")
    result = plan.ingest(raw, F.lit("2024-02-01").cast("timestamp"), stored, materialize=True)
    row = result.summary.first()
    assert (row.accepted_count, row.duplicate_count, row.rejected_count) == (7, 2, 3)
    assert sorted(r.id for r in result.accepted.collect()) == sorted({f"a{n}" for n in range(8)} - {"a3"})
    assert looked.value == 12
    assert result.errors.count() == 3
