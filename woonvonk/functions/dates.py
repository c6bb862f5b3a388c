"""Dates in the formats that listings use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from woonvonk.functions.casts import col, rx, strip

# Numeric formats, and month names with their numbers.
NUMERIC_FORMATS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyy/M/d"]
MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8,
    "september": 9, "oktober": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mrt": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10,
}
DAY_MONTH_YEAR = rx(r"(\d{1,2})\s+([a-zà-ÿ]+)\s+(\d{4})")


def parse_date(value: str | Column) -> Column:
    """Four numeric formats, then ``d MONTH yyyy`` with Dutch or English month names."""
    text = strip(col(value))
    lowered = F.lower(text)
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.regexp_extract(lowered, DAY_MONTH_YEAR, 2))
    day = F.regexp_extract(lowered, DAY_MONTH_YEAR, 1)
    year = F.regexp_extract(lowered, DAY_MONTH_YEAR, 3)
    written = F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "yyyy-M-d")
    return F.coalesce(
        *[F.try_to_date(text, fmt) for fmt in NUMERIC_FORMATS], F.when(month.isNotNull(), written)
    )


def iso_date(value: str | Column) -> Column:
    """First ten characters as an ISO date."""
    return F.try_to_date(F.substring(strip(col(value)), 1, 10), "yyyy-MM-dd")


def zulu_date(value: str | Column) -> Column:
    """ISO date or date-time, with or without ``Z``."""
    return F.regexp_replace(strip(col(value)), r"Z$", "+00:00").try_cast("timestamp").cast("date")


def days_on_market(listed_since: str | Column, reference: str | Column) -> Column:
    days = F.datediff(col(reference), col(listed_since))
    return F.when(days >= 0, days)
