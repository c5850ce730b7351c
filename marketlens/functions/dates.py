"""Dates of ads: age, republication, local time and seasons, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Departments where winter tyres are compulsory, and southern ones where they wear out in spring.
MOUNTAIN = "01 03 04 05 06 07 09 11 12 15 25 26 31 38 39 42 43 48 57 63 64 65 66 67 68 69 70 73 74 81 83 84 88 90".split()
SOUTH = "04 05 06 11 12 13 30 31 34 48 64 65 66 81 83 84".split()
DAY_MS = 86_400_000


def days_since(published: Column, now: Column) -> Column:
    """Whole days since an ISO date as text, negative for a future one; null if it is none."""
    at = F.try_to_timestamp(F.regexp_replace(published, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def republished(created: Column, modified: Column) -> Column:
    """Whether more than a day lies between two times in milliseconds; null if one is missing."""
    return F.abs(modified - created) > DAY_MS


def local_time(utc: Column, zone: str = "Europe/Paris") -> Column:
    return F.from_utc_timestamp(utc, zone)


def tyre_signal(department: Column, day: Column) -> Column:
    """What a buyer should ask about winter tyres: `before`, `season` or `after`, or null."""
    month, mountain = F.month(day), department.isin(MOUNTAIN)
    return F.when((month == 10) & mountain, "before").when(((month >= 11) | (month <= 3)) & mountain, "season").when((month == 4) & department.isin(SOUTH), "after")
