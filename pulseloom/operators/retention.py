"""Expiry of signals and incidents by the retention profile of an environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.analysis import retention_profile


def cutoff(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days=days)


def signal_cutoff(env: Column, as_of: Column) -> Column:
    return cutoff(as_of, retention_profile(env)["raw_days"])


def incident_cutoff(env: Column, as_of: Column) -> Column:
    return cutoff(as_of, retention_profile(env)["incident_days"])


def _expired(time: Column, limit: Column) -> Column:
    """Strictly older than the limit; a missing time never expires."""
    return F.coalesce(time < limit, F.lit(False))


def signal_expired(limit: Column) -> Column:
    return _expired(F.col("timestamp"), limit)


def incident_expired(limit: Column) -> Column:
    return _expired(F.coalesce("updated_at", "created_at"), limit)


def keep_signals(signals: DataFrame, limit: Column) -> DataFrame:
    return signals.filter(~signal_expired(limit))


def keep_incidents(incidents: DataFrame, limit: Column) -> DataFrame:
    return incidents.filter(~incident_expired(limit))


def expired_count(rows: DataFrame, expired: Column) -> DataFrame:
    """One row: how many rows an expiry removes."""
    return rows.agg(F.count_if(expired).alias("deleted"))


def oldest_expired(rows: DataFrame, expired: Column, time: str, k: int) -> DataFrame:
    """The k oldest expired rows by (time, id): a preview, planned as a top-k."""
    return rows.filter(expired).orderBy(time, "id").limit(k)
