"""Ingest of one set of batches: validate, find duplicates, split into branches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.ingest import (
    flag_duplicates,
    ingest_summary,
    outcomes,
    rejected_errors,
    stored_form,
    valid_signals,
    validate_signals,
)
from pulseloom.session import checkpointed


@dataclass
class Ingested:
    accepted: DataFrame  # raw text, for correlation
    stored: DataFrame  # masked and redacted, for storage
    summary: DataFrame
    errors: DataFrame


def ingest(
    raw: DataFrame,
    as_of: Column,
    stored_ids: DataFrame | None = None,
    allow_list: Column | DataFrame | None = None,
    materialize: bool = False,
) -> Ingested:
    """All results start from the same flagged rows.

    ``materialize`` fixes the checked and the flagged rows first; needed when storing them changes
    what ``stored_ids`` reads.
    """
    validated = validate_signals(raw, as_of)
    # Several passes go over the checked rows; the lists of errors are left to who reads them.
    checked = checkpointed(validated.drop("errors")) if materialize else validated
    flagged = flag_duplicates(valid_signals(checked), stored_ids, checked)
    if materialize:
        flagged = checkpointed(flagged)
    accepted = flagged.filter(~F.col("is_duplicate")).drop("is_duplicate")
    summary = ingest_summary(outcomes(flagged, checked))
    return Ingested(accepted, stored_form(accepted, allow_list), summary, rejected_errors(validated))
