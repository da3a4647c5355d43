"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(name: str, default) -> Column:
    """The column, with null and zero (or an empty string) counted as missing."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(F.col(name), F.lit(empty)), F.lit(default))


def tier(value: Column, steps: list[tuple], otherwise=0, over: bool = False) -> Column:
    """The points of the first step whose limit the value reaches (over: exceeds); steps go from the highest limit down. Null gives otherwise."""
    out = None
    for limit, points in steps:
        test = value > limit if over else value >= limit
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(otherwise)


def under(value: Column, steps: list[tuple], otherwise=0) -> Column:
    """The points of the first step that the value is below; steps go from the lowest limit up."""
    out = None
    for limit, points in steps:
        out = F.when(value < limit, points) if out is None else out.when(value < limit, points)
    return out.otherwise(otherwise)


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def half_up(value: Column) -> Column:
    """Nearest integer, halves upwards, as a long."""
    return F.floor(value + 0.5)


def tokens(text: Column) -> Column:
    """Words in lower case: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def host(url: Column) -> Column:
    """Host in lower case without www., null for what isn't an http(s) url."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))
