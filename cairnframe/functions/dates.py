"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(c: Column) -> Column:
    """Year of an ISO date text; null where it is shorter than a date or no date."""
    return F.when(F.length(c) >= 10, F.year(F.try_to_date(F.substring(c, 1, 10))))


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def days_since(dates: Column, as_of: Column) -> Column:
    """Days from the last date of a list; null for an empty list."""
    return F.datediff(as_of, F.try_element_at(dates, F.lit(-1)))
