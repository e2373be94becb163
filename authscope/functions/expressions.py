"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token that stands for a missing value, and the day that second 0 is anchored to.
MISSING, ANCHOR = "?", "2015-01-01"


def missing_to_null(name: str) -> Column:
    """Only an exact token is missing; one inside a longer value stays."""
    return F.nullif(F.col(name), F.lit(MISSING)).alias(name)


def day_of(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86400)).cast("int")


def hour_of(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / F.lit(3600)).cast("int")


def date_of(day: Column) -> Column:
    return F.date_add(F.lit(ANCHOR).cast("date"), day)


def timestamp_of(seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(ANCHOR).cast("timestamp")) + seconds)


def name_part(identity: Column, at: int) -> Column:
    """Part of name@domain; null where it isn't there."""
    return F.get(F.split(identity, "@"), F.lit(at))


def is_machine(identity: Column) -> Column:
    return identity.rlike(r"\$@")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole isn't positive; a null part stays null."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))


def in_band(hour: Column, band: list[int]) -> Column:
    return hour.isin(list(band)) if band else F.lit(False)


def key(value: Column) -> Column:
    """Surrogate key: md5 of the value's text."""
    return F.md5(value.cast("string"))


def week_of(day: Column, mode: str = "round") -> Column:
    """Week bucket of a day index. `round` gives what the published results show; `floor` is calendar-like."""
    return (F.round(day / F.lit(7.0)) if mode == "round" else F.floor(day / F.lit(7))).cast("int")


def zscore(value: Column, mean: Column, deviation: Column, rows: Column, least: int = 3) -> Column:
    """Null with fewer than `least` baseline rows or without spread."""
    return F.when((rows >= least) & (deviation > 0), (value - mean) / F.nullif(deviation, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda x, y: x | y, (value.startswith(p) for p in prefixes))
