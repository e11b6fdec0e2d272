"""Ingestion counters of a running stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulseloom.operators.ingest import ACCEPTED, DUPLICATE, REJECTED
from pulseloom.sources.store import read_table

OUTCOMES = "ingest_outcomes"
COUNTS = tuple(f"{o}_count" for o in (ACCEPTED, DUPLICATE, REJECTED))
LIVE_COUNTS = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("window_start", T.TimestampType())])


def observe_outcomes(classified: DataFrame, name: str = OUTCOMES) -> DataFrame:
    """Count outcomes on the way through; rows pass unchanged."""
    return classified.observe(
        name,
        *[F.count_if(F.col("outcome") == o).alias(o) for o in (ACCEPTED, DUPLICATE, REJECTED)],
    )


class OutcomeListener(StreamingQueryListener):
    """Adds up observed outcome counts of all progress reports."""

    def __init__(self, name: str = OUTCOMES) -> None:
        self.name = name
        self.totals = dict.fromkeys((ACCEPTED, DUPLICATE, REJECTED), 0)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for outcome in self.totals:
                self.totals[outcome] += row[outcome]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def append_summary(summary: DataFrame, path: str, epoch: int, as_of: Column) -> None:
    """Keep the batch counters of an epoch; a repeated epoch replaces its own."""
    (
        summary.withColumn("as_of", as_of)
        .withColumn("epoch", F.lit(epoch).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch")
        .parquet(path)
    )


def rolling_counts(summaries: DataFrame, width: str = "1 hour") -> DataFrame:
    """Outcome counts per time window of the appended summaries."""
    return summaries.groupBy(F.window("as_of", width).alias("w")).agg(*[F.sum(c).alias(c) for c in COUNTS]).select(
        F.col("w.start").alias("window_start"), *COUNTS
    )


def summary_stream(spark: SparkSession, path: str) -> DataFrame:
    """The summaries at ``path`` as a stream; at least one epoch has been written.

    Files of an epoch that ran again are replaced while the stream may know the old ones.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).option("ignoreMissingFiles", "true").parquet(path)


def live_counts(summaries: DataFrame, width: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """:func:`rolling_counts` of a stream of summaries, for update mode.

    A summary that comes twice, because its epoch ran again, counts once: its
    epoch, batch and instant are the same. Epochs may arrive late by ``watermark``;
    windows and repeats older than that leave the state. :func:`rolling_counts` over
    the stored summaries is exact for any lateness.
    """
    once = summaries.withWatermark("as_of", watermark).dropDuplicates(["epoch", "batch_id", "as_of"])
    return rolling_counts(once, width)


def stream_counts(
    spark: SparkSession, base: str, checkpoint: str, width: str = "1 hour", watermark: str = "1 day", **trigger: object
) -> StreamingQuery:
    """Keep the counts of every window of the ingest below ``base`` up to date in ``base/counts``.

    An update carries a window's whole count and replaces its partition, so a
    repeated micro-batch changes nothing; :func:`read_counts` reads the table.
    """

    def replace(batch: DataFrame, _: int) -> None:
        writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("window_start").parquet(f"{base}/counts")

    return (
        live_counts(summary_stream(spark, f"{base}/metrics"), width, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counts(spark: SparkSession, base: str) -> DataFrame:
    """window_start and the counts so far; empty before the first update."""
    return read_table(spark, f"{base}/counts", LIVE_COUNTS).select("window_start", *COUNTS)
