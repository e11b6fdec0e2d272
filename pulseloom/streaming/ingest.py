"""Continuous ingest and correlation, one restartable micro-batch at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulseloom.operators.incidents import upsert_incidents
from pulseloom.operators.ingest import default_id
from pulseloom.operators.sessions import DEFAULT_WINDOW_US
from pulseloom.plans.correlate import correlate
from pulseloom.plans.ingest import Ingested, ingest
from pulseloom.schemas import INCIDENT_SIGNALS, INCIDENTS
from pulseloom.session import checkpointed
from pulseloom.sources.signal_store import SignalStore
from pulseloom.sources.store import overwrite_partitions, read_table
from pulseloom.streaming.metrics import append_summary


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def epoch_time(spark: SparkSession, folder: str, epoch: int, now: dt.datetime | None = None) -> Column:
    """The instant an epoch first ran, so a repeated run sees the same "now".

    ``now`` (with its time zone) takes the clock's place in the first run.
    """
    path = f"{folder}/epoch={epoch}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        at = (now or dt.datetime.now(dt.timezone.utc)) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        row = spark.range(1).select(F.lit(at // dt.timedelta(microseconds=1)).alias("as_of_us"))
        row.coalesce(1).write.mode("overwrite").parquet(path)
    return F.timestamp_micros(F.lit(spark.read.parquet(path).first()["as_of_us"]))


def ingest_epoch(
    raw: DataFrame,
    epoch: int,
    base: str,
    allow_list: Column | DataFrame | None = None,
    metrics: bool = True,
    now: dt.datetime | None = None,
) -> Ingested:
    """Store one micro-batch below ``base``. Late rows are stored like any other.

    Which ids are stored the store's index tells, without a look at other ids;
    those the same epoch stored in an earlier run do not count.
    """
    spark = raw.sparkSession
    as_of = epoch_time(spark, f"{base}/epochs", epoch, now)
    store = SignalStore(spark, f"{base}/signals")
    ids = raw.select(default_id(F.col("id"), F.col("batch_id"), F.col("pos")).alias("id"))
    result = ingest(raw, as_of, store.known_ids(ids, epoch), allow_list, materialize=True)
    store.append(result.stored.drop("batch_id", "pos"), epoch)
    if metrics:
        append_summary(result.summary, f"{base}/metrics", epoch, as_of)
    return result


def correlate_epoch(
    accepted: DataFrame, epoch: int, base: str, rules: DataFrame, patterns: DataFrame, window_us: int = DEFAULT_WINDOW_US
) -> None:
    """Correlate one accepted micro-batch into the incident table below ``base``.

    The change set of an epoch is written first and reused if the epoch runs
    again, because applying it changes which incidents are open.
    """
    spark = accepted.sparkSession
    table, changes, links = f"{base}/incidents", f"{base}/changes/epoch={epoch}", f"{base}/links"
    as_of = epoch_time(spark, f"{base}/epochs", epoch)
    if not _exists(spark, f"{changes}/_SUCCESS"):
        known = read_table(spark, links, T.StructType([*INCIDENT_SIGNALS.fields, T.StructField("epoch", T.LongType())])).filter(F.col("epoch") != epoch)
        result = correlate(accepted, read_table(spark, table, INCIDENTS).select(*INCIDENTS.names), rules, patterns, as_of, window_us, known_links=known)
        (
            result.links.withColumn("epoch", F.lit(epoch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(links)
        )
        result.changes.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(changes)
    delta = spark.read.schema(INCIDENTS).parquet(changes)
    # The join on the partition column prunes the partitions that are read.
    days = delta.select(F.to_date("created_at").alias("created_on")).distinct()
    stored = read_table(spark, table, T.StructType([*INCIDENTS.fields, T.StructField("created_on", T.DateType())]))
    touched = stored.join(days, "created_on", "left_semi").drop("created_on")
    merged = upsert_incidents(touched, delta, as_of)
    overwrite_partitions(merged.withColumn("created_on", F.to_date("created_at")), table, "created_on")


def stream_ingest(
    raw_stream: DataFrame,
    base: str,
    checkpoint: str,
    allow_list: Column | DataFrame | None = None,
    on_accepted: Callable[[DataFrame, int], None] | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Start continuous ingest; ``on_accepted`` gets the raw accepted rows of each epoch."""
    outer = raw_stream.sparkSession

    def run(batch: DataFrame, epoch: int) -> None:
        # Read the source once, and go on in the outer session with adaptive plans.
        result = ingest_epoch(checkpointed(batch, outer), epoch, base, allow_list)
        if on_accepted is not None:
            on_accepted(result.accepted, epoch)

    return (
        raw_stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_incidents(
    raw_stream: DataFrame,
    base: str,
    checkpoint: str,
    rules: DataFrame,
    patterns: DataFrame,
    allow_list: Column | DataFrame | None = None,
    window_us: int = DEFAULT_WINDOW_US,
    **trigger: object,
) -> StreamingQuery:
    """Ingest and correlate: each micro-batch is one job, related through open incidents."""

    def follow(accepted: DataFrame, epoch: int) -> None:
        correlate_epoch(accepted, epoch, base, rules, patterns, window_us)

    return stream_ingest(raw_stream, base, checkpoint, allow_list, follow, **trigger)
