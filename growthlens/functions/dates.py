"""Date parsing and formatting. Every parser gives NULL on text it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years up to this one belong to 2000-2068, later ones to 1969-1999.
LAST_TWO_DIGIT_YEAR = 2068


def year_of(text: Column | str) -> Column:
    """Leading four-digit year of a year (`2016`) or a school year (`2016/2017`)."""
    return F.substring(F.trim(_col(text).cast("string")), 1, 4).try_cast("int")


def year_start(year: Column | str) -> Column:
    """1 January of a year given as number or text."""
    return F.make_date(_col(year).try_cast("int"), F.lit(1), F.lit(1))


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "MM")


def month_year(text: Column | str) -> Column:
    """Month start from `Jan-81`, with ISO dates and `YYYY-MM` accepted as a fallback."""
    c = F.trim(_col(text))
    short = F.try_to_timestamp(c, F.lit("MMM-yy")).cast("date")
    century = F.when(F.year(short) > LAST_TWO_DIGIT_YEAR, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(century, c.try_cast("date"))


def iso_text(c: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Text form used at the sinks; `dd-MM-yyyy` is the other pattern in use."""
    return F.date_format(_col(c), pattern)


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c
