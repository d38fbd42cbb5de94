"""Text to typed columns. A value that does not parse becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text shapes. \A and \z are used because ^ and $ would
# accept a trailing line break.
DATE_SHAPE = r"\A\d{4}-\d{1,2}-\d{1,2}"
SIGNED_INTEGER = r"\A[+-]?[0-9]+\z"
PLAIN_DIGITS = r"\A[0-9]+\z"
CENT_AMOUNT = r"\A[+]?[0-9]+([.][0-9]{1,2})?\z"

UNKNOWN = "UNKNOWN"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def text_to_timestamp(text: Column) -> Column:
    """Zone-free timestamp; year-only and year-month text is refused."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(DATE_SHAPE), trimmed.try_cast("timestamp_ntz"))


def _number_text(text: Column) -> Column:
    """Trimmed text without single underscores between digits."""
    return F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", "")


def text_to_key_integer(text: Column) -> Column:
    """Integer for key columns: fractions and exponents are refused."""
    return _number_text(text).try_cast("int")


def text_to_integer(text: Column) -> Column:
    """Integer for descriptive columns: fractions round half up."""
    return F.round(_number_text(text).try_cast("decimal(38,9)")).try_cast("int")


def text_to_money(text: Column) -> Column:
    return F.trim(text).try_cast("decimal(18,2)")


def text_to_double(text: Column) -> Column:
    """Double; a type suffix after the number (12d, 1.5F) is no number."""
    number = _number_text(text)
    return F.when(~number.rlike(r"[0-9.][dDfF]$"), number.try_cast("double"))


def text_to_score(text: Column) -> Column:
    """Only a signed integer literal is a score, so 1.5 is not rounded into a rating."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(SIGNED_INTEGER), trimmed.try_cast("int"))


def unknown_member(column: Column) -> Column:
    return F.coalesce(column, F.lit(UNKNOWN))


def text_to_flag(text: Column) -> Column:
    """Boolean read back from exported text: true and 1 are true, the rest false."""
    return F.coalesce(F.lower(text).isin("true", "1"), F.lit(False))
