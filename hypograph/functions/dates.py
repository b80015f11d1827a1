"""Date expressions. Missing or unreadable dates are NULL, never a sentinel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """``d-M-yyyy`` or ``d-MMM-yyyy`` to DATE, anything else to NULL."""
    return F.coalesce(
        F.try_to_date(text, "d-M-yyyy"),
        F.try_to_date(text, "d-MMM-yyyy"),
    )


def epoch_seconds(day: Column) -> Column:
    """Seconds since 1970-01-01 of a DATE at midnight UTC, whatever the session zone is."""
    return F.unix_date(day).cast("bigint") * F.lit(86400)


def date_of_epoch(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))


def year_of(text: Column) -> Column:
    """Year of a date text with exactly two dashes and at least four year digits."""
    parts = F.split(text, "-")
    year = F.element_at(parts, 3)
    ok = (F.size(parts) == 3) & (F.length(year) >= 4)
    return F.when(ok, F.substring(year, 1, 4).try_cast("int"))


def month_of(text: Column) -> Column:
    parts = F.split(text, "-")
    return F.when(F.size(parts) == 3, F.element_at(parts, 2).try_cast("int"))


def month_year(text: Column) -> Column:
    return F.when(
        year_of(text).isNotNull() & month_of(text).isNotNull(),
        F.concat_ws("-", month_of(text), year_of(text)),
    )


def month_tag(day: Column) -> Column:
    """Tag that corpus file names carry for a month, such as ``_2010_Aug_``."""
    return F.date_format(day, "'_'yyyy'_'MMM'_'")


def tagged_month(path: Column) -> Column:
    """First day of the month a corpus file name is tagged with."""
    year = F.regexp_extract(path, r"_(\d{4})_([A-Z][a-z]{2})_", 1)
    month = F.regexp_extract(path, r"_(\d{4})_([A-Z][a-z]{2})_", 2)
    return F.try_to_date(F.concat_ws("-", F.lit("1"), month, year), "d-MMM-yyyy")
