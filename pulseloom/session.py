"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
_scratch: list[str] = []

# Settings the operators rely on. AQE supplies the run-time size check for
# broadcasts and the splitting of skewed join partitions; the session merge
# flag pre-merges streaming sessions before their shuffle.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else created."""
    for key, value in ENGINE_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "pulseloom", cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**ENGINE_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local master, where every task shares the machine, may fall back to
    a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="pulseloom-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, for tables a job needs only while it runs."""
    _scratch.append(f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4()}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables this process has written; call it when their results are stored elsewhere."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """Cut lineage: ``df`` as a table written to the shared checkpoint folder.

    It survives lost executors, is read back with its real size known to the
    planner, and later reads prune columns. :func:`drop_scratch` deletes it. ``session`` reads it back in another session: streams
    run their micro-batches in a copy of the session without adaptive execution.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return (session or df.sparkSession).read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, materialize: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is below ``max_bytes``.

    Planned sizes of joins and aggregates are guesses; with a large guess Spark
    shuffles the other side before it learns better. This measures instead (one
    aggregate job). Above the limit ``df`` comes back without a hint and joins by
    shuffle. ``materialize`` computes ``df`` once, for use after the measuring.
    """
    held = checkpointed(df) if materialize else df
    width = F.sum(F.octet_length(F.to_json(F.struct(*held.columns))))
    size = held.agg(F.coalesce(width, F.lit(0)).alias("size")).first()["size"]
    return F.broadcast(held) if size <= max_bytes else held
