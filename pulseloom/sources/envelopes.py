"""Ingest envelopes: one JSON text per batch, exploded to one row per signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.strict import not_text, one_value
from pulseloom.session import broadcast_if_small

TEXTS = ("id", "eventType", "source", "environment", "timestamp", "message")
_TYPED = (
    "sourceContext variant, signals array<struct<id variant, eventType variant, source variant, environment variant, timestamp variant, "
    "severity int, message variant, payload map<string,variant>, metadata map<string,variant>>>, _corrupt string"
)


def parse_envelopes(texts: DataFrame) -> DataFrame:
    """Parse ``value`` of (batch_id, value) rows, batch or stream. A ``batch_id`` names one envelope.

    Text fields are read as variants first, since Spark would turn any value into
    text: a number or an object there refuses the batch, as does text after the JSON.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    typed = texts.withColumn("_typed", F.from_json("value", _TYPED, options))

    def odd(s):
        labels = F.coalesce(F.exists(F.map_values(s["metadata"]), not_text), F.lit(False))
        return F.array_contains(F.array(*[not_text(s[c]) for c in TEXTS], labels), True)

    def plain(s):
        fields = [s[c].cast("string").alias(c) if c in TEXTS else s[c].alias(c) for c in (*TEXTS[:5], "severity", "message", "payload")]
        return F.struct(*fields, F.transform_values(s["metadata"], lambda _, v: v.cast("string")).alias("metadata"))

    signals = F.col("_typed.signals")
    wrong = ~one_value(F.col("value")) | not_text(F.col("_typed.sourceContext")) | F.coalesce(F.exists(signals, odd), F.lit(False))
    envelope = F.struct(
        F.col("_typed.sourceContext").cast("string").alias("sourceContext"),
        F.transform(signals, plain).alias("signals"),
        F.coalesce("_typed._corrupt", F.when(wrong, F.col("value"))).alias("_corrupt"),
    )
    return typed.withColumn("envelope", F.when(F.col("_typed").isNotNull(), envelope)).drop("_typed")


def _is_bad():
    return (
        F.col("envelope").isNull()
        | F.col("envelope._corrupt").isNotNull()
        | (F.coalesce(F.size("envelope.signals"), F.lit(0)) <= 0)
    )


def quarantined_batches(parsed: DataFrame) -> DataFrame:
    """Batches refused as a whole: not JSON, a wrong type, or no signals."""
    malformed = F.col("envelope").isNull() | F.col("envelope._corrupt").isNotNull()
    reason = F.when(malformed, F.lit("malformed body")).otherwise(
        F.lit("signals is required and must contain at least one item")
    )
    return parsed.filter(_is_bad()).select("batch_id", "value", reason.alias("reason"))


def envelope_signals(parsed: DataFrame) -> DataFrame:
    """One row per signal of the batches that are not refused."""
    rows = parsed.filter(~_is_bad()).select("batch_id", F.posexplode("envelope.signals").alias("pos", "s"))
    return rows.select(
        "batch_id",
        "pos",
        F.col("s.id").alias("id"),
        F.col("s.eventType").alias("event_type"),
        F.col("s.source").alias("source"),
        F.col("s.environment").alias("environment"),
        F.col("s.timestamp").alias("timestamp"),
        F.col("s.severity").alias("severity"),
        F.col("s.message").alias("message"),
        F.to_json("s.payload").alias("payload"),
        F.col("s.metadata").alias("metadata"),
    )


def read_envelopes(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Envelopes from files: one per line, or one per file.

    ``batch_id`` names the place: the file and, for lines, the line's number in
    it. It does not depend on how Spark cuts files into tasks, so a job that
    runs again with other settings gives signals without ids the same ids. For this
    the lines of every block are counted before they are read.
    """
    file = F.col("_metadata.file_path").alias("file")
    if whole_files:
        return parse_envelopes(spark.read.text(path, wholetext=True).select(file.alias("batch_id"), "value"))
    # A task may read several blocks: lines are numbered in the task, blocks tell where they begin.
    lines = spark.read.text(path).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(broadcast_if_small(offsets, materialize=True), ["file", "block"])
    number = F.lpad((F.col("at") + F.col("shift")).cast("string"), 12, "0")
    return parse_envelopes(placed.select(F.concat_ws("#", "file", number).alias("batch_id"), "value"))
