"""Date and identifier expressions for the raw results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable_date(c: str | Column) -> Column:
    """A ``yyyyMMdd`` text as a date; null unless it is exactly eight digits and a real day."""
    c = F.col(c) if isinstance(c, str) else c
    digits = (F.length(c) == 8) & (F.length(F.translate(c, "0123456789", "")) == 0)
    return F.when(digits, F.try_to_date(c, "yyyyMMdd"))


def clean_id(c: str | Column) -> Column:
    """A player id without the trailing ``.0`` of a float column; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c)
    bare = F.when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(bare != "", bare)
