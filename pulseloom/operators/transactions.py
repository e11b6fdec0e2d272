"""Requests that get all of their keys or none, served in the order of their ids.

Whether a request succeeds hangs on the smaller requests that share a key with
it. Four rules settle them, none of which emits the pairs of a key:

* a request that is the first asker of all its keys succeeds, and whoever asks
  for a key of it later fails;
* requests tied by keys form components; one of bounded size is settled by a
  single ordered scan;
* in larger ones, a request that waits for exactly one other fails where that
  one succeeds and the other way round. Such waits form chains, and pointer
  doubling tells every link its distance to the head, so a chain of n links
  takes about log n joins;
* what is left goes through the rules again.

Each pass settles the smallest request of every component at least. In the worst
case (a huge component in which everybody waits for several others) the order is
inherently sequential and passes are many; they stay linear in the rows left.
Joins are merged, as broadcasts of every pass would add up on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators.groups import connected
from pulseloom.session import checkpointed

SCAN_ROWS = 100_000  # rows (request, key) of a component that one ordered scan may settle


def _heads(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with _first, the smallest request of the key, and _second, the next one or null."""
    first = rows.groupBy(*key).agg(F.min("request_id").alias("_first"))
    led = rows.join(first.hint("merge"), key)
    later = F.when(F.col("request_id") != F.col("_first"), F.col("request_id"))
    second = led.groupBy(*key).agg(F.min(later).alias("_second"))
    return led.join(second.hint("merge"), key)


def free_requests(rows: DataFrame, key: list[str]) -> DataFrame:
    """request_id, accepted (true) of the requests that are first at all their keys."""
    first = rows.groupBy(*key).agg(F.min("request_id").alias("_first"))
    waits = F.bool_or(F.col("request_id") != F.col("_first"))
    return rows.join(first.hint("merge"), key).groupBy("request_id").agg((~waits).alias("accepted")).where("accepted")


def chain_outcomes(rows: DataFrame, key: list[str]) -> DataFrame:
    """request_id, accepted of all requests that a chain of single waits ties to a free request, and of the free ones.

    The second asker of a key waits for the first only; a later one waits for
    several, so two minima for each key find the single waits.
    """
    me, first, second = (F.col(c) for c in ("request_id", "_first", "_second"))
    waiting = me != first
    by_request = _heads(rows, key).groupBy("request_id").agg(
        F.bool_or(waiting).alias("_waits"),
        F.bool_or(waiting & (me != second)).alias("_several"),
        F.min(F.when(waiting, first)).alias("_low"),
        F.max(F.when(waiting, first)).alias("_high"),
    )
    single = F.col("_waits") & ~F.col("_several") & (F.col("_low") == F.col("_high"))
    links = checkpointed(
        by_request.select(
            "request_id",
            F.when(single, F.col("_low")).otherwise(me).alias("at"),
            single.alias("odd"),
            (~F.col("_waits")).alias("free"),
        )
    )
    while True:
        far = links.select(F.col("request_id").alias("at"), F.col("at").alias("_at"), F.col("odd").alias("_odd"), F.col("free").alias("_free"))
        step = links.join(far.hint("merge"), "at").select(
            "request_id",
            F.col("_at").alias("at"),
            (F.col("odd") != F.col("_odd")).alias("odd"),
            F.col("_free").alias("free"),
            (F.col("at") != F.col("_at")).alias("_moved"),
        )
        links = checkpointed(step)
        if links.where("_moved").isEmpty():
            return links.where("free").select("request_id", (~F.col("odd")).alias("accepted"))
        links = links.drop("_moved")


def _with_component(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with group, the smallest request tied to theirs, and _rows, the rows of that group."""
    first = rows.groupBy(*key).agg(F.min("request_id").alias("a"))
    links = rows.join(first.hint("merge"), key).select("a", F.col("request_id").alias("b")).distinct()
    grouped = rows.join(connected(links).withColumnRenamed("node", "request_id").hint("merge"), "request_id")
    return grouped.join(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_rows")).hint("merge"), "group")


def scan_outcomes(rows: DataFrame, key: list[str]) -> DataFrame:
    """request_id, accepted by one scan in order of each group of ``rows``; a task holds the keys of one group."""
    ordered = rows.select("group", "request_id", *key).repartition("group").sortWithinPartitions("group", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = request = None
        taken, wanted = set(), []
        done = []

        def close():
            free = taken.isdisjoint(wanted)
            if free:
                taken.update(wanted)
            done.append((request, free))

        for batch in batches:
            for g, r, *k in batch.itertuples(index=False, name=None):
                if wanted and (g, r) != (group, request):
                    close()
                    wanted = []
                if g != group:
                    taken = set()
                group, request = g, r
                wanted.append(tuple(k))
            if done:
                yield pd.DataFrame(done, columns=["request_id", "accepted"])
                done.clear()
        if wanted:
            close()
            yield pd.DataFrame(done, columns=["request_id", "accepted"])

    return ordered.mapInPandas(run, T.StructType([rows.schema["request_id"], T.StructField("accepted", T.BooleanType())]))


def accepted_requests(asked: DataFrame, key: list[str], scan_rows: int = SCAN_ROWS) -> DataFrame:
    """The rows (request_id, key columns) of the requests that succeed.

    As a loop over the requests in order would find them: a request succeeds if no
    smaller one that succeeded has one of its keys. Repeated rows count once; rows
    without a request_id or with a null in the key take no part.
    """
    columns = ["request_id", *key]
    undecided = checkpointed(asked.select(*columns).dropna().distinct())
    decided, accepted = checkpointed(free_requests(undecided, key)), []
    while True:
        won = checkpointed(undecided.join(decided.where("accepted").hint("merge"), "request_id", "left_semi").select(*columns))
        accepted.append(won)
        lost = undecided.join(won.select(*key).hint("merge"), key, "left_semi").select("request_id")
        out = decided.select("request_id").unionByName(lost).distinct()
        undecided = checkpointed(undecided.join(out.hint("merge"), "request_id", "left_anti"))
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
        grouped = checkpointed(_with_component(undecided, key))
        decided = scan_outcomes(grouped.where(F.col("_rows") <= scan_rows), key)
        large = grouped.where(F.col("_rows") > scan_rows).select(*columns)
        if not large.isEmpty():
            decided = decided.unionByName(chain_outcomes(large, key))
        decided = checkpointed(decided)
