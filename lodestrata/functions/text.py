"""Names, lists and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, blanks as underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def joined(c: Column) -> Column:
    """The sorted members of an array as one text."""
    return F.array_join(F.array_sort(c), ",")


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def in_years(c: Column, first: int, last: int) -> Column:
    """From the first day of one year to the last of another; a range, so that scans can skip by it."""
    return (c >= F.lit(f"{first}-01-01").cast("date")) & (c < F.lit(f"{last + 1}-01-01").cast("date"))
