"""Every named query against its SQL twin, and what its plan must not contain."""

import pytest

import __spark_entry__ as contract
from pulseloom import catalog
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# The suggester hook runs user Python by its nature.
PYTHON_ALLOWED = {"fallback_analysis"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["flagship_incidents", "insert_signals", "sessionize_bucketed", "related_incident", "claim_incidents", "sanitize_documents", "upsert_incidents"]
)
def test_plans_stay_in_the_engine(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def written_plans(monkeypatch):
    """Plans of the tables that session marking writes from now on."""
    from pulseloom.operators import sessions as ses

    seen, plain = [], ses.checkpointed
    monkeypatch.setattr(ses, "checkpointed", lambda frame, *rest: seen.append(plan(frame)) or plain(frame, *rest))
    return seen


def test_analysis_reads_the_signals_once(spark, monkeypatch):
    written = written_plans(monkeypatch)
    text = plan(catalog.queries()["flagship_incidents"](spark, SF))
    # Cells are written from one scan, reduced before its only shuffle; all else reads cells.
    assert len(written) == 1 and written[0].count("FileScan") == 1 and written[0].count("Exchange hashpartitioning") == 1
    assert "partial_min" in written[0] and "partial_max" in written[0][written[0].index("Exchange hashpartitioning(source") :]
    assert "events.parquet" in written[0] and "events.parquet" not in text


def test_session_summary_prunes_columns(spark, monkeypatch):
    written = written_plans(monkeypatch)
    catalog.queries()["sessionize_60s"](spark, SF)
    assert "props" not in written[0] and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in written[0]


def test_ids_are_reduced_before_their_shuffle(spark):
    from pulseloom.catalog.signals import validated
    from pulseloom.operators.ingest import known_ids, valid_signals

    assert "partial_min(struct" in plan(known_ids(valid_signals(validated(spark, SF))))


def test_signals_are_not_shuffled_for_few_duplicates_or_cells(spark):
    for name in ("first_write_wins", "sessionize_bucketed"):
        assert "Exchange hashpartitioning" not in plan(catalog.queries()[name](spark, SF))


def test_a_large_side_is_not_broadcast(spark):
    from pulseloom.session import broadcast_if_small

    frame = spark.range(1_000)
    assert "Broadcast" not in plan(spark.range(10).join(broadcast_if_small(frame, 100).hint("shuffle_hash"), "id"))
    assert "BroadcastHashJoin" in plan(frame.join(broadcast_if_small(spark.range(10).toDF("id"), materialize=True), "id"))


def test_top_k_is_not_a_global_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["oldest_expired"](spark, SF))


def test_expiry_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from pulseloom.operators.retention import signal_expired
    from pulseloom.sources.tables import table

    orders = table(spark, SF, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"))
    text = plan(orders.filter(signal_expired(F.lit("1997-01-01").cast("timestamp_ntz"))))
    assert "PushedFilters: [" in text
