"""Names and numbers as text: symbols, file names, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_symbol(symbol: Column) -> Column:
    """A symbol in lower case without the prefix of its market (x:) and the suffix of its currency (usd)."""
    return F.regexp_replace(F.regexp_replace(F.lower(symbol), r"^x:", ""), r"-?usd$", "")


def time_unit(file: Column) -> Column:
    """The unit that a file's name mentions."""
    low = F.lower(file)
    return F.when(low.contains("minute"), "Minutes").when(low.contains("hour"), "Hours").when(low.contains("day"), "Days").otherwise("Time Units")


def with_commas(x: Column, places: int = 2) -> Column:
    return F.format_number(x, places)


def number(text: Column) -> Column:
    """A number that may have commas between thousands; null where it is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def scaled(x: Column, decimals: int) -> Column:
    """An amount of the smallest unit in whole ones."""
    return x / float(10**decimals)
