"""Parsing of text columns. All casts are `try_cast`: bad text becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English month abbreviations, so that parsing does not depend on the locale.
MONTHS = {"Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
          "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_number(c: Column | str) -> Column:
    """Month number of a leading `Mon`, null when it is not an English abbreviation."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return table[F.substring(_column(c), 1, 3)]


def text_year(c: Column | str) -> Column:
    """Year in the last four characters, null when they are not a number."""
    return F.substring(_column(c), -4, 4).try_cast("int")


def year_month(c: Column | str) -> Column:
    """`Aug-2003` as a fractional year, 2003 + 7/12."""
    year = F.substring(_column(c), -4, 4).try_cast("double")
    return year + (month_number(c).cast("double") - 1) / F.lit(12.0)


def years_between(later: Column | str, earlier: Column | str) -> Column:
    """Difference of two `Mon-YYYY` columns in years."""
    return year_month(later) - year_month(earlier)


def first_integer(c: Column | str) -> Column:
    """First run of digits as a double, null when there is none."""
    return F.regexp_extract(_column(c), r"(\d+)", 1).try_cast("double")


def duration_years(c: Column | str) -> Column:
    """Employment length: `10+ years` 10, `< 1 year` 0, `3 years` 3, otherwise null."""
    column = _column(c)
    return F.when(column.startswith("<"), F.lit(0.0)).otherwise(first_integer(column))


def number(c: Column | str) -> Column:
    """Text to double; malformed text and blanks become null."""
    return _column(c).try_cast("double")


def text_key(c: Column | str) -> Column:
    return _column(c).cast("string")


def head_part(c: Column | str, separator: str = ":") -> Column:
    """Text before the first separator."""
    return F.split(_column(c), separator, 2)[0]
