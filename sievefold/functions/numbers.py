"""Numeric parsing with one grammar in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"


def is_number(x: Column) -> Column:
    """Null passes; otherwise the text must read as a number."""
    return x.isNull() | x.cast("string").rlike(NUMBER)


def to_number(x: Column) -> Column:
    """A double; bad texts and NaN become null."""
    text = x.cast("string")
    value = F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))
    return F.when(~F.isnan(value), value)


def null_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
