import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from pulseloom.schemas import SIGNALS
from pulseloom.sources.signal_store import SignalStore

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def rows_of(spark, rows):
    """rows: (id, env, days before T0 or None)"""
    full = [(i, "log", "svc", env, None if days is None else T0 - dt.timedelta(days=days), 1, f"m {i}", '{"k":1}', {"a": i}) for i, env, days in rows]
    return spark.createDataFrame(full, SIGNALS)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def asked(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture
def store(spark, tmp_path):
    return SignalStore(spark, str(tmp_path / "store of +signals"), buckets=4, blocks=2)


def test_versions_are_whole_or_absent(spark, store):
    assert store.version() == 0 and ids(store.read()) == [] and ids(store.known_ids(asked(spark, ["a"]))) == []
    first = rows_of(spark, [("a", "production", 1), ("b", "staging", 1), ("c", None, 2), ("d", "production", None)])
    assert store.append(first, 0) == 1
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, first.collect()))
    assert store.append(rows_of(spark, [("e", "production", 1)]), 1) == 2
    # The same epoch again, as after a failure of the job behind it.
    assert store.append(rows_of(spark, [("e", "production", 1)]), 1) == 2
    assert ids(store.read()) == ["a", "b", "c", "d", "e"] and ids(store.read(1)) == ["a", "b", "c", "d"]
    # A load nobody committed, as after a crash in the middle of one.
    store._write(rows_of(spark, [("lost", "production", 1)]))
    assert ids(store.read()) == ["a", "b", "c", "d", "e"]
    assert store.vacuum(keep=2) == 1
    assert ids(store.read(1)) == ["a", "b", "c", "d"]


def test_known_ids_are_exact(spark, store):
    names = [f"id-{n}" for n in range(300)]
    store.append(rows_of(spark, [(n, "production", 1) for n in names[:100]]), 0)
    store.append(rows_of(spark, [(n, "staging", 2) for n in names[100:200]]), 1)
    assert ids(store.known_ids(asked(spark, [*names, None]))) == sorted(names[:200])
    assert ids(store.known_ids(asked(spark, names), epoch=1)) == sorted(names[:100])
    maybe = set(ids(store.maybe_stored(asked(spark, names))))
    assert set(names[:200]) <= maybe and len(maybe) < 230


def test_new_ids_open_nothing_however_much_is_stored(spark, tmp_path):
    read = []
    for size in (50, 2_000):
        store = SignalStore(spark, str(tmp_path / str(size)), buckets=2, blocks=2)
        store.append(rows_of(spark, [(f"id-{n}", "production", n % 20) for n in range(size)]), 0)
        fresh = asked(spark, [f"new-{n}" for n in range(12)])
        assert store.known_ids(fresh).inputFiles() == [] or size > 50
        plan = store.known_ids(asked(spark, ["id-7"]))._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*\(bucket#\d+ = [01]\)", plan)  # one bucket of two
        read.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / str(size) / "filters") for f in names if f.endswith(".parquet")))
    assert read[1] < 2 * 2 * 4096 * 1.5  # the filters keep their size


def test_expiry_reads_only_files_the_cutoff_goes_through(spark, store):
    rows = [("p-old", "production", 31), ("p-edge", "production", 30), ("p-new", "production", 1), ("s-old", "staging", 14.01), ("s-new", "staging", 13.99), ("d-old", "development", 7.5), ("x", "production", None)]
    rows += [("d-mixed-old", "development", 7.2), ("d-mixed-new", "development", 6.99)]
    store.append(rows_of(spark, rows), 0)
    before = {r.file for r in store.files().collect()}
    reader = store.read()
    store.expire(F.lit(T0))
    want = ["d-mixed-new", "p-edge", "p-new", "s-new", "x"]
    assert ids(store.read()) == want
    assert len(ids(reader)) == len(rows)  # who opened the old version reads it to the end
    after = {r.file for r in store.files().collect()}
    assert {f.split("env=")[1].split("/")[0] for f in after - before} <= {"development", "staging"}
    # Expired ids may come again, the others not.
    assert ids(store.known_ids(asked(spark, [r[0] for r in rows]))) == want
    store.expire(F.lit(T0))
    assert ids(store.read()) == want and {r.file for r in store.files().collect()} == after


def test_compaction_changes_no_row(spark, store):
    for epoch in range(4):
        store.append(rows_of(spark, [(f"{epoch}-{n}", ("production", "staging")[n % 2], n % 3) for n in range(30)]), epoch)
    store.append(rows_of(spark, [("old", "development", 9)]), 4)
    store.expire(F.lit(T0))
    names = ids(store.read())
    many = store.files().count()
    wide = SignalStore(spark, store.path, buckets=7, blocks=1)
    wide.compact()
    assert store.files().count() < many and ids(wide.read()) == names and len(names) == 120
    assert ids(wide.known_ids(asked(spark, [*names, "old", "none"]))) == names
    assert wide.append(rows_of(spark, [("2-0", "production", 0)]), 2) == wide.version()  # an epoch of long ago again
    assert ids(wide.known_ids(asked(spark, names), epoch=3)) == [n for n in names if not n.startswith("3-")]
    assert wide.vacuum() > 0 and ids(wide.read()) == names
    days = wide.read(since=F.lit(T0 - dt.timedelta(days=1)), until=F.lit(T0))
    assert ids(days) == [n for n in names if int(n.split("-")[1]) % 3 < 2]
    assert len(days.inputFiles()) < wide.files().count()
