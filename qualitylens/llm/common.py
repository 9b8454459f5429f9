"""Expressions and helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualitylens.session import ARROW_ROWS, arrow_batches  # noqa: F401

#: The white space of every contract, for trimming and for patterns.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"

def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, SPACE))).otherwise(F.lit(0)).cast("long")
