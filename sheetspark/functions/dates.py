"""Date expressions: format of a date text, parsing, printing, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_whitespace

# The date formats that are recognised, in order of preference,
# each with the pattern that prints it and the pattern that parses it.
DATE_FORMATS = [
    ("MM/DD/YYYY", "MM/dd/yyyy", "M/d/yyyy"),
    ("DD/MM/YYYY", "dd/MM/yyyy", "d/M/yyyy"),
    ("YYYY-MM-DD", "yyyy-MM-dd", "yyyy-M-d"),
    ("YYYY/MM/DD", "yyyy/MM/dd", "yyyy/M/d"),
    ("YYYY/DD/MM", "yyyy/dd/MM", "yyyy/d/M"),
    ("MM-DD-YYYY", "MM-dd-yyyy", "M-d-yyyy"),
    ("DD-MM-YYYY", "dd-MM-yyyy", "d-M-yyyy"),
    ("MM.DD.YYYY", "MM.dd.yyyy", "M.d.yyyy"),
    ("DD.MM.YYYY", "dd.MM.yyyy", "d.M.yyyy"),
    ("YYYY.MM.DD", "yyyy.MM.dd", "yyyy.M.d"),
]
FORMAT_NAMES = [name for name, _, _ in DATE_FORMATS]
PRINT_PATTERN = {name: shown for name, shown, _ in DATE_FORMATS}
PARSE_PATTERN = {name: parsed for name, _, parsed in DATE_FORMATS}
UNKNOWN = "Unknown"

_SEPARATORS = {"/": "/", "-": "-", ".": r"\."}


def format_of(value: Column) -> Column:
    """Name of the format one text fits, or null.

    Day-first (or year-day-month) is chosen only on evidence, that is when the
    place of the month holds a number above 12.
    """
    branches = F
    for sep, escaped in _SEPARATORS.items():
        trailing = rf"^(\d{{1,2}}){escaped}(\d{{1,2}}){escaped}\d{{4}}"
        leading = rf"^\d{{4}}{escaped}(\d{{1,2}}){escaped}(\d{{1,2}})"
        first = F.regexp_extract(value, trailing, 1).try_cast("int")
        second = F.regexp_extract(value, trailing, 2).try_cast("int")
        month_first, day_first = f"MM{sep}DD{sep}YYYY", f"DD{sep}MM{sep}YYYY"
        name = F.when((first > 12) & (second <= 12), day_first).otherwise(month_first)
        # A slash date must have exactly three parts.
        whole = F.lit(True) if sep != "/" else F.size(F.split(value, "/")) == 3
        rule = value.rlike(trailing)
        branches = branches.when(rule, F.when(whole, name))
        if sep == "/":
            month = F.regexp_extract(value, leading, 1).try_cast("int")
            year_name = F.when(month > 12, "YYYY/DD/MM").otherwise("YYYY/MM/DD")
            branches = branches.when(value.rlike(leading), F.when(whole, year_name))
        else:
            branches = branches.when(value.rlike(leading), f"YYYY{sep}MM{sep}DD")
    return branches


def parse_date(value: Column, format_name: str | None) -> Column:
    """Timestamp without zone; text that does not fit becomes null."""
    if format_name in PARSE_PATTERN:
        pattern = PARSE_PATTERN[format_name]
        short = F.trim(value)
        spaced = F.regexp_replace(collapse_whitespace(value), r"(?<=\d)T(?=\d)", " ")
        with_time = F.try_to_timestamp(spaced, F.lit(pattern + "[ H:mm[:ss[.SSSSSS]]]"))
        # The longest bare date has ten characters, and the plain pattern is faster.
        # Going by the date drops what the session's zone does to midnight.
        day_only = F.try_to_timestamp(short, F.lit(pattern)).cast("date").cast("timestamp_ntz")
        return F.when(F.length(short) <= 10, day_only).otherwise(with_time.cast("timestamp_ntz"))
    return collapse_whitespace(value).try_cast("timestamp_ntz")


def print_like(value: Column, format_name: str | None) -> Column:
    return F.date_format(value, PRINT_PATTERN.get(format_name or "", "yyyy-MM-dd"))


def month_year(value: Column, format_name: str | None) -> Column:
    """``MM/yyyy`` for slash dates, ``yyyy/MM`` for year-first slash dates, else ISO."""
    if format_name in ("MM/DD/YYYY", "DD/MM/YYYY"):
        return F.date_format(value, "MM/yyyy")
    if format_name in ("YYYY/MM/DD", "YYYY/DD/MM"):
        return F.date_format(value, "yyyy/MM")
    return F.date_format(value, "yyyy-MM")
