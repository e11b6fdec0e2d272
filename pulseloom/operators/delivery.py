"""Delivery statistics from a log of (job_id, attempt, step, ts_us) rows.

Steps are enqueue, deliver, ack and nack. A receipt is good for one attempt: an ack
or nack counts if it is the first of its attempt and no later attempt was
delivered before it. Attempts are reduced before they meet per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_ATTEMPTS = 3
DEFAULT_TIMEOUT_US = 30_000_000

ACKED, READY, IN_FLIGHT, DEAD = "acked", "ready", "in-flight", "dead-letter"


def delivery_outcomes(
    log: DataFrame, as_of_us: Column, max_attempts: int = DEFAULT_MAX_ATTEMPTS, timeout_us: int = DEFAULT_TIMEOUT_US
) -> DataFrame:
    """State, attempts and retries of every job as of an instant.

    A nack and an expired lease both count as a retry, also when the job then
    goes to the dead letters instead of another attempt.
    """
    max_attempts = max(int(max_attempts), 1)
    timeout_us = int(timeout_us) if timeout_us > 0 else DEFAULT_TIMEOUT_US
    step, at = F.col("step"), F.col("ts_us")
    first = lambda name: F.min(F.when(step == name, at)).alias(name)
    tries = log.filter(at <= as_of_us).groupBy("job_id", "attempt").agg(
        F.max(F.when(step == "deliver", at)).alias("delivered"), first("ack"), first("nack")
    )
    # Once a later attempt is delivered, the receipt of this one is gone. A job has few attempts.
    later = Window.partitionBy("job_id").orderBy("attempt").rowsBetween(1, Window.unboundedFollowing)
    settled = F.least("ack", "nack")
    current = tries.withColumn("until", F.min("delivered").over(later)).withColumn("settled", settled)
    current = current.withColumn("settled", F.when(F.col("until").isNull() | (F.col("settled") < F.col("until")), F.col("settled")))
    delivered = F.col("delivered").isNotNull()
    jobs = current.groupBy("job_id").agg(
        F.coalesce(F.max(F.when(delivered, F.col("attempt"))), F.lit(0)).alias("attempts"),
        F.max("delivered").alias("_delivered_us"),
        F.coalesce(F.max(F.when((F.col("nack") == F.col("settled")) & ~F.col("ack").eqNullSafe(F.col("settled")), F.col("attempt"))), F.lit(0)).alias("_nacked"),
        F.coalesce(F.bool_or(F.col("ack") == F.col("settled")), F.lit(False)).alias("_acked"),
        F.max("settled").alias("last_processed_us"),
    )
    nacked = (F.col("attempts") > 0) & (F.col("_nacked") == F.col("attempts"))
    expired = ~nacked & (as_of_us >= F.col("_delivered_us") + F.lit(timeout_us))
    failed = F.coalesce(nacked | expired, F.lit(False))
    outcome = (
        F.when(F.col("_acked"), F.lit(ACKED))
        .when(F.col("attempts") == 0, F.lit(READY))
        .when(failed & (F.col("attempts") + 1 > max_attempts), F.lit(DEAD))
        .when(failed, F.lit(READY))
        .otherwise(F.lit(IN_FLIGHT))
    )
    # Every attempt but the last one failed; the last one may have.
    retries = F.greatest(F.col("attempts") - 1, F.lit(0)) + F.when(~F.col("_acked") & failed, 1).otherwise(0)
    return jobs.select("job_id", outcome.alias("outcome"), "attempts", retries.alias("retries"), "last_processed_us")


def delivery_stats(outcomes: DataFrame) -> DataFrame:
    """Queue counters as one row."""
    return outcomes.agg(
        F.count_if(F.col("outcome").isin(READY, IN_FLIGHT)).alias("queue_depth"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retry_count"),
        F.count_if(F.col("outcome") == DEAD).alias("dead_letter_count"),
        F.max("last_processed_us").alias("last_processed_us"),
    )


def health_snapshot(outcomes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Queue counters and the number of incidents as one row.

    Both counts are partial rows of one final aggregate, so no join is needed.
    """
    stats = delivery_stats(outcomes).withColumn("incidents", F.lit(0).cast("long"))
    counted = incidents.agg(F.count(F.lit(1)).alias("incidents"))
    return stats.unionByName(counted, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("queue_depth", "retry_count", "dead_letter_count", "last_processed_us", "incidents")]
    )
