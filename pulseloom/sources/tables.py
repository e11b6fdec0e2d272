"""Adapters from the shared test tables to the tables of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.regex import to_jvm_regex
from pulseloom.session import apply_conf

# The four rules and five patterns of the shared fixtures.
RULE_ROWS = [
    # id, priority, match type, hypothesis, recommendations
    ("r1", 80, "single", "Dependency timeouts", "Inspect timeouts|Scale consumers"),
    ("r2", 90, "correlation", "Connection pool exhausted under retries", "Raise pool size|Inspect timeouts"),
    ("r3", 80, "single", "Credential failures", "Rotate credentials"),
    ("r4", 50, "ALL", "Queue backlog", "Scale consumers"),
]
PATTERN_ROWS = [
    # id, rule, event type, source, environment, match type, pattern, condition field, bound
    ("p1", "r1", "log", "svc-0", "production", "regex", "timeout after [0-9]+ms", "k", "50.0"),
    ("p2", "r2", "database", "svc-0", "production", "contains", "connections", None, None),
    ("p3", "r2", "queue", "svc-0", "production", "exact", "retry succeeded", None, None),
    ("p4", "r3", "log", "svc-1", "staging", "contains", "password", None, None),
    ("p5", "r4", "queue", "svc-1", "staging", "contains", "backlog", None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(value: object) -> str:
    if value is None:
        return "cast(null as string)"
    return str(value) if isinstance(value, int) else "r'" + str(value).replace("'", "\\'") + "'"


def values_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small literal table as SQL VALUES, so Spark knows how small it is."""
    body = ",\n".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values\n{body}\nas t({columns})")


def sample_rules(spark: SparkSession, rows: list[tuple] = RULE_ROWS) -> DataFrame:
    raw = values_table(spark, rows, "id, priority, match_type, hypothesis_template, advice")
    return raw.select(
        "id",
        F.col("id").alias("name"),
        F.lit("").alias("description"),
        F.lit(0.5).alias("confidence"),
        F.col("priority").cast("int").alias("priority"),
        F.lit(True).alias("enabled"),
        "match_type",
        "hypothesis_template",
        F.split("advice", r"\|").alias("recommendations"),
        F.lit(1).alias("version"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000)).alias("created_at"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000)).alias("updated_at"),
    )


def sample_patterns(spark: SparkSession, rows: list[tuple] = PATTERN_ROWS) -> DataFrame:
    with_regex = [(*row, to_jvm_regex(row[6]) if row[5] == "regex" else None) for row in rows]
    raw = values_table(
        spark,
        with_regex,
        "id, rule_id, event_type, source, environment, message_match_type, message_pattern, field, bound, message_regex",
    )
    condition = F.struct("field", F.lit("greater_than").alias("operator"), F.col("bound").alias("value"))
    return raw.select(
        "id",
        "rule_id",
        "event_type",
        "source",
        "environment",
        F.lit(0).alias("severity_min"),
        "message_match_type",
        "message_pattern",
        F.filter(F.array(condition), lambda c: c["field"].isNotNull()).alias("payload_conditions"),
        F.create_map().cast("map<string,string>").alias("variable_mappings"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000)).alias("created_at"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000)).alias("updated_at"),
        "message_regex",
    )


EVENT_TYPE = """case event_type when 'error' then 'log' when 'view' then 'health' when 'click' then 'queue'
  when 'purchase' then 'database' else 'deployment' end"""
MESSAGE = """case event_id % 7 when 0 then 'timeout after 120ms' when 1 then 'login failed password=hunter2; retry'
  when 2 then 'mail ops@example.com about queue backlog' when 3 then 'Authorization: Bearer abc.def=='
  when 4 then 'too many connections' when 5 then '' else 'retry succeeded' end"""
SEVERITY = "cast(cast(floor(value) as bigint) % 6 as int)"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(table(spark, sf_dir, "events"))


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_signals_of(table(spark, sf_dir, "events"))


def signals_of(events: DataFrame) -> DataFrame:
    """Valid signals, one per event."""
    return events.selectExpr(
        "concat('evt-', event_id) as id",
        f"{EVENT_TYPE} as event_type",
        "concat('svc-', user_id % 5) as source",
        "case event_id % 3 when 0 then 'production' when 1 then 'staging' else 'development' end as env",
        "cast(ts as timestamp) as `timestamp`",
        f"{SEVERITY} as severity",
        f"{MESSAGE} as message",
        "props as payload",
        "cast(map() as map<string,string>) as metadata",
    )


def raw_signals_of(events: DataFrame) -> DataFrame:
    """Signals as clients send them: bad values, missing ones and repeated ids."""
    return events.selectExpr(
        "cast(floor(event_id / 100) as bigint) as batch_id",
        "cast(event_id % 100 as int) as pos",
        "concat('evt-', case when event_id % 29 = 0 and event_id > 0 then event_id - 1 else event_id end) as id",
        f"""case when event_id % 11 = 0 then 'oops' when event_id % 13 = 0 then ''
            else {EVENT_TYPE} end as event_type""",
        "case when event_id % 31 = 0 then '' else concat('svc-', user_id % 5) end as source",
        """case event_id % 5 when 0 then ' PROD ' when 1 then 'stage' when 2 then 'Development'
           when 3 then 'production' else 'qa' end as environment""",
        """case when event_id % 23 = 0 then 'not-a-time' when event_id % 37 = 0 then cast(null as string)
           else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") end as `timestamp`""",
        f"case when event_id % 17 = 0 then 9 when event_id % 19 = 0 then cast(null as int) else {SEVERITY} end as severity",
        f"{MESSAGE} as message",
        "props as payload",
        "cast(map() as map<string,string>) as metadata",
    )
