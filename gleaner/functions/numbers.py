"""Numeric coercion of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark casts also take Java suffixes such as '1d'; plain numerals only here.
_NUMERAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_nullable_long(col: Column) -> Column:
    """Half-to-even rounding; whatever is not a numeral becomes null."""
    text = col.cast("string")
    number = F.when(text.rlike(_NUMERAL), text.try_cast("double"))
    return F.bround(number, 0).try_cast("bigint")
