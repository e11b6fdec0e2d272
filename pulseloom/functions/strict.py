"""JSON as strict as typed decoding: one value, and text fields that hold text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_value(text: Column) -> Column:
    """Whether ``text`` is exactly one JSON value, with nothing after it (false for null)."""
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return F.coalesce(F.size(wrapped) == 1, F.lit(False))


def not_text(value: Column) -> Column:
    """Whether a variant holds anything but text or null."""
    return value.isNotNull() & ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).isin("STRING", "VOID")
