"""Conversions of security codes: ``600519.SH``, ``sh.600519`` and bare six-digit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def market_of(code: Column) -> Column:
    """The exchange of a bare code, by its first digit: 6 is Shanghai, 4 and 8 are Beijing, all others Shenzhen."""
    first = F.substring(code, 1, 1)
    return F.when(first == "6", "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")


def with_suffix(code: Column) -> Column:
    """Any form to ``600519.SH``."""
    parts = F.split(F.upper(F.trim(code)), r"\.")
    dotted = F.when(F.get(parts, F.lit(0)).rlike("^[0-9]{6}$"), F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
    return F.when(F.size(parts) == 2, dotted).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("."), market_of(F.get(parts, F.lit(0)))))


def with_prefix(code: Column) -> Column:
    """Any form to ``sh.600519``."""
    parts = F.split(with_suffix(code), r"\.")
    return F.lower(F.concat(F.get(parts, F.lit(1)), F.lit("."), F.get(parts, F.lit(0))))
