"""Date parsing of usage text and invoice period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.schema import DAY_SUFFIX

# Only ISO-like text (year first) is a date; Spark alone would also read '2024-01'.
_ISO_DATE_PREFIX = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_date(col) -> Column:
    """``TRY_CAST(x AS DATE)`` restricted to year-month-day text; anything else is null.
    ``2024/01/05`` reads as ``2024-01-05``."""
    c = _col(col)
    # with dashes there, the patterns below change nothing and refuse nothing that the cast reads
    plain = (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-")
    dashed = F.regexp_replace(c, r"^(\s*\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.when(plain, c.try_cast(T.DateType())).when(c.rlike(_ISO_DATE_PREFIX), dashed.try_cast(T.DateType()))


def stored_or_parsed(df, other: str, usage_date: str = "UsageDate") -> Column:
    """The readable day of the usage date text, or of the text of column ``other`` where there
    is no usage date. A table that stores parsed days (``<name>_day``) is not parsed again."""
    if all(c + DAY_SUFFIX in df.columns for c in (usage_date, other)):
        return F.when(F.col(usage_date).isNotNull(), F.col(usage_date + DAY_SUFFIX)).otherwise(F.col(other + DAY_SUFFIX))
    return lenient_date(F.coalesce(F.col(usage_date), F.col(other)))


def usage_day(df) -> Column:
    """The day a usage row belongs to: its usage date, else its charge start date."""
    return stored_or_parsed(df, "ChargeStartDate")


def period_label(start_text, end_text) -> Column:
    """``January 2024`` when start and end fall in one month, else
    ``Jan 05, 2024 - Feb 03, 2024``; ``N/A`` when either end is missing or unreadable."""
    start, end = lenient_date(start_text), lenient_date(end_text)
    same_month = F.date_format(start, "yyyy-MM") == F.date_format(end, "yyyy-MM")
    span = F.concat(F.date_format(start, "MMM dd, yyyy"), F.lit(" - "), F.date_format(end, "MMM dd, yyyy"))
    label = F.when(same_month, F.date_format(start, "MMMM yyyy")).otherwise(span)
    return F.when(start.isNull() | end.isNull(), F.lit("N/A")).otherwise(label)


def display_date(col) -> Column:
    """``2024-01-05`` text of a date or timestamp."""
    return F.date_format(_col(col), "yyyy-MM-dd")


def display_datetime(col) -> Column:
    """``2024-01-05 13:45`` text of a timestamp."""
    return F.date_format(_col(col), "yyyy-MM-dd HH:mm")
