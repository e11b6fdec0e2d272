"""Text that every match of a pattern must contain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3


def required_literals(regex: str) -> list[str]:
    """Texts that every match of ``regex`` contains; none where that is not plain to see.

    Only characters outside groups and classes count, and only if they must occur:
    a character before ``?``, ``*`` or a count is left out. A pattern with
    alternatives or flags gives nothing.
    """
    found, run, i, depth = [], "", 0, 0
    if "|" in regex or "(?" in regex or "\\Q" in regex:
        return []
    while i < len(regex):
        c, step, keep = regex[i], 1, ""
        if c == "\\" and i + 1 < len(regex):
            step = 2
            keep = "" if regex[i + 1].isalnum() else regex[i + 1]
            if not keep and regex[i + 1] in "pPxuU0123456789":
                return []
        elif c == "[":
            end = regex.find("]", i + (3 if regex[i + 1 : i + 2] == "^" else 2))
            if end < 0 or "[" in regex[i + 1 : end] or "\\" in regex[i:end]:
                return []
            step = end + 1 - i
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c in "?*{":
            run = run[:-1]
            step = regex.find("}", i) + 1 - i if c == "{" else 1
            if step <= 0:
                return []
        elif c not in ".^$+})]":
            keep = c
        if keep and not depth:
            run += keep
        else:
            found, run = [*found, run] if run else found, ""
        i += step
    return [*found, run] if run else found


def _grams(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    def of(kind: str | None, text: str | None) -> list[str]:
        literals = required_literals(text or "") if kind == "regex" else [text or ""]
        return sorted({t[i : i + GRAM] for t in literals for i in range(len(t) - GRAM + 1)})

    return pd.Series([of(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)


def pattern_grams(match_type: Column, pattern: Column) -> Column:
    """All GRAM-character texts every matching message contains; for saving with a rule, not for the hot path."""
    return F.pandas_udf(_grams, T.ArrayType(T.StringType()))(match_type, pattern)


def message_grams(message: Column) -> Column:
    """The distinct GRAM-character texts of a message."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
