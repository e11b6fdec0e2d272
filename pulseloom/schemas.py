"""Table schemas. Payloads and condition values stay JSON text at rest."""

from pyspark.sql import types as T

SIGNALS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("env", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

# One element of the "signals" array in an ingest envelope. ``payload`` is read
# as raw JSON text so that value types survive until a condition needs them.
ENVELOPE_SIGNAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("sourceContext", T.StringType()),
        T.StructField("signals", T.ArrayType(ENVELOPE_SIGNAL)),
        T.StructField("_corrupt", T.StringType()),
    ]
)

# An incident names its signals in the link table INCIDENT_SIGNALS: one row per
# signal, so an incident of any size stays splittable.
INCIDENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("impacted_services", T.ArrayType(T.StringType())),
        T.StructField("environments", T.ArrayType(T.StringType())),
        T.StructField("analysis_summary", T.StringType()),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

INCIDENT_SIGNALS = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("signal_id", T.StringType()),
    ]
)

PAYLOAD_FILTERS = T.StructType(
    [
        T.StructField("environment", T.StringType()),
        T.StructField("allow_payload", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("hypothesis_template", T.StringType()),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CONDITION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# ``message_regex`` is derived: the JVM form of a regex pattern, null if invalid.
PATTERNS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("severity_min", T.IntegerType()),
        T.StructField("message_match_type", T.StringType()),
        T.StructField("message_pattern", T.StringType()),
        T.StructField("payload_conditions", T.ArrayType(CONDITION)),
        T.StructField("variable_mappings", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("message_regex", T.StringType()),
    ]
)

DELIVERY_LOG = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("step", T.StringType()),
        T.StructField("ts_us", T.LongType()),
    ]
)
