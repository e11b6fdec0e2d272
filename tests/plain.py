"""Plain statements of rules, without regard to hot keys: what tests compare with."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def sessionize_by_lag(signals, window_us, keys=("source", "env")):
    """Members by one ordered window per key."""
    by_time = Window.partitionBy(*keys).orderBy("ts_us", "id")
    timed = signals.withColumn("ts_us", F.unix_micros("timestamp"))
    pause = F.col("ts_us") - F.lag("ts_us").over(by_time)
    starts = F.when(pause.isNull() | (pause > F.lit(int(window_us))), F.col("ts_us"))
    return timed.withColumn("_start", starts).withColumn("session_start", F.max("_start").over(by_time)).drop("_start")


def session_windows(signals, window_us):
    """Sessions by the window function the streaming form uses."""
    return (
        signals.groupBy("source", "env", F.session_window("timestamp", f"{window_us + 1} microseconds").alias("w"))
        .agg(F.min(F.unix_micros("timestamp")).alias("session_start"), F.count(F.lit(1)).alias("signal_count"))
        .drop("w")
    )
