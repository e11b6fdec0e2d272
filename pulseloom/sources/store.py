"""Parquet tables: append and whole-partition rewrite, one writer per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.operators.retention import keep_signals, signal_cutoff, signal_expired
from pulseloom.session import checkpointed


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; empty before the first write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_signals(signals: DataFrame, path: str, epoch: int = 0) -> None:
    """Append under (date, epoch). Running an epoch again replaces what its first
    run wrote, so a repeated micro-batch leaves one copy. Rebalancing makes files
    of even size whether a day is hot or nearly empty. The bloom filter lets id
    lookups skip row groups."""
    (
        signals.withColumn("dt", F.to_date("timestamp"))
        .withColumn("epoch", F.lit(epoch).cast("long"))
        .hint("rebalance", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("dt", "epoch")
        .parquet(path)
    )


def overwrite_partitions(rows: DataFrame, path: str, *partition_columns: str) -> None:
    """Replace the partitions ``rows`` has. The rows may come from ``path`` itself:
    they are written to the checkpoint folder before the first file is replaced."""
    (
        checkpointed(rows)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_columns)
        .parquet(path)
    )


def replace_table(rows: DataFrame, path: str) -> None:
    """Rewrite a small table (rules, patterns, filters) as a whole."""
    checkpointed(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def expire_signals(spark: SparkSession, path: str, schema: T.StructType, env: Column, as_of: Column) -> None:
    """Expire stored signals (partitioned by dt, epoch) by the profile of ``env``.

    Only partitions that hold an expired row are rewritten; one that loses all
    of its rows is removed as a folder. Partition columns prune the scan.
    """
    limit = signal_cutoff(env, as_of)
    stored = spark.read.schema(
        T.StructType([*schema.fields, T.StructField("dt", T.DateType()), T.StructField("epoch", T.LongType())])
    ).parquet(path).filter(F.col("dt") <= F.to_date(limit))
    old = stored.filter(signal_expired(limit))
    touched = old.select("dt", "epoch").distinct()
    kept = keep_signals(stored.join(touched, ["dt", "epoch"], "left_semi"), limit)
    kept = checkpointed(kept)
    emptied = checkpointed(touched.join(kept.select("dt", "epoch").distinct(), ["dt", "epoch"], "left_anti"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "epoch").parquet(path)
    # One row per emptied partition, i.e. a list of folders, not of data.
    for row in emptied.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={row.dt}/epoch={row.epoch}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
