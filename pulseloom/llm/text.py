"""Column expressions on whole texts, without Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that ends a word.
BLANKS = " \t\n\x0b\f\r"
_BLANK, _WORD = "[ \\x09-\\x0D]", "[^ \\x09-\\x0D]"


def word_count(text: Column) -> Column:
    """Number of words (runs outside space and 0x09-0x0D); null and blank texts have 0."""
    ended = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(ended, f"{_BLANK}*+{_WORD}++", "w")).cast("long")
