"""Text expressions: naming, cleaning, printing of cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The error texts a spreadsheet prints in a cell.
ERROR_TOKENS = ["#VALUE!", "#N/A", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!"]


# Any Unicode white space, with the four separators that text libraries add.
WHITESPACE = r"(?U)[\s\x{1C}-\x{1F}]"
PLAIN_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "


def ident(name: str) -> Column:
    """Column by exact header text, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def number_text(value: Column) -> Column:
    """Shortest decimal text; plain digits for magnitudes in [1e-4, 1e16)."""
    printed = value.cast("string")
    size = F.abs(value.cast("double"))
    expanded = F.regexp_replace(printed.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    needs = printed.contains("E") & (size >= 1e-4) & (size < 1e16)
    return F.when(needs, expanded).otherwise(printed)


def timestamp_text(value: Column, separator: str = " ") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with six fraction digits when there are any.

    A cast, not a format: formatting would take zone-less times through the
    session's zone and its clock changes.
    """
    printed = value.cast("string")
    full = F.when(F.length(printed) > 19, F.rpad(printed, 26, "0")).otherwise(printed)
    return full if separator == " " else F.replace(full, F.lit(" "), F.lit(separator))


def second_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a timestamp, in the same way."""
    return F.substring(value.cast("string"), 1, 19)


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Cell as text; null stays null."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.initcap(value.cast("string"))
    if is_fractional(dtype):
        return number_text(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")


def remove_spaces(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def remove_literals(value: Column, literals: list[str]) -> Column:
    """Delete each literal, in the order given."""
    return reduce(lambda acc, lit: F.replace(acc, F.lit(lit), F.lit("")), [x for x in literals if x], value)


def collapse_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, WHITESPACE + "+", " "))


def special_only(value: Column) -> Column:
    """Text without ASCII letters, digits and spaces."""
    return F.translate(value, PLAIN_CHARACTERS, "")


def is_empty(value: Column, dtype: T.DataType | None = None) -> Column:
    """Null, or '' where the column holds text."""
    missing = value.isNull()
    return missing | (value == "") if dtype is None or isinstance(dtype, T.StringType) else missing


def is_error_token(value: Column) -> Column:
    return F.coalesce(value.isin(ERROR_TOKENS), F.lit(False))


def file_basename(path: Column) -> Column:
    """Part after the last slash or back-slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(file_basename(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def file_extension(path: Column) -> Column:
    """Last extension with its dot, or ''."""
    return F.regexp_extract(file_basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def sheet_title(number: Column, plot_name: Column) -> Column:
    """Tab title of the n-th chart: at most 31 letters, digits, ' ', '_' or '-'."""
    raw = F.concat(F.lit("Plot_"), number.cast("string"), F.lit("_"), F.substring(plot_name, 1, 20))
    kept = F.rtrim(F.regexp_replace(raw, r"[^\p{L}\p{N} _-]", ""))
    return F.substring(kept, 1, 31)


def short_name(name: Column) -> Column:
    """First ten characters without special characters."""
    return F.regexp_replace(F.substring(name, 1, 10), r"[^\p{L}\p{N} _-]", "")


def joined_short_names(names: Column, fallback: Column | str, longest: int = 200) -> Column:
    """``a+b+c.csv`` of short names; the fallback once that passes ``longest``."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    joined = F.concat(F.array_join(F.transform(names, short_name), "+"), F.lit(".csv"))
    return F.when(F.length(joined) > longest, other).otherwise(joined)


_HEADER_SIGNS = str.maketrans({"\n": " ", "\r": None} | dict.fromkeys("\\/", "_"))


def clean_header(name: str) -> str:
    """Header as exported: no period prefix, one line, no path separators."""
    return re.sub("[Pp]eriod_", "", name).strip().translate(_HEADER_SIGNS)


def strip_period_prefix(value: Column) -> Column:
    return F.when(value.startswith("Period_"), F.replace(value, F.lit("Period_"), F.lit(""))).otherwise(value)


def contains_ci(value: Column, needle: str) -> Column:
    return F.lower(value).contains(needle.lower())


def equals_ci(value: Column, other: str) -> Column:
    return F.lower(value) == other.lower()


def contains_any_ci(value: Column, words: list[str]) -> Column:
    """True when any word occurs; one alternation keeps it a single pass."""
    if not words:
        return F.lit(False)
    pattern = "|".join(re.escape(w.lower()) for w in words)
    return F.coalesce(F.lower(value).rlike(pattern), F.lit(False))
