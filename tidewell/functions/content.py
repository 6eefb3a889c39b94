"""What a text value looks like, and its conversion to a type.

Patterns use ASCII digits and letters.  A failed conversion of a value that isn't
blank gives null here; callers report it (see ``operators.validation``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.strings import blank, strip

#: Fixed values.
CURRENCY_START = "^(INR|USD|EUR|GBP|[$€£₹¥])"
CURRENCY_MARKS = "INR|USD|EUR|GBP|[$€£₹¥, ]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^([0-9]{4}(-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{1,2}(-[0-9]{1,2}-|/[0-9]{1,2}/)[0-9]{4})"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^((\+([0-9]{1,3}-?)?)?[0-9]{10,15}|\([0-9]{3,4}\)[0-9]{6,10})$"
BOOLEANS = ("1", "0", "true", "false", "yes", "no", "y", "n", "on", "off", "enabled", "disabled", "active", "inactive")
TRUE = ("1", "true", "yes", "y", "on", "enabled", "active")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "M/d/yyyy", "M-d-yyyy")
DAY_FIRST_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "d/M/yyyy", "d-M-yyyy")


def is_currency(c: Column) -> Column:
    return strip(c).rlike(CURRENCY_START)


def bare_number(c: Column) -> Column:
    """Without currency marks, thousands separators, enclosing parentheses and a trailing percent sign."""
    x = F.regexp_replace(strip(c), CURRENCY_MARKS, "")
    return F.regexp_replace(F.regexp_replace(x, r"^\((.*)\)$", "$1"), "%$", "")


def is_number(c: Column) -> Column:
    return bare_number(c).rlike(NUMBER)


def is_date(c: Column) -> Column:
    return strip(c).rlike(DATE)


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL)


def is_phone(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[^0-9+()-]", "").rlike(PHONE)


def is_boolean(c: Column) -> Column:
    return F.lower(strip(c)).isin(*BOOLEANS)


# ---- conversion


def to_number(c: Column, legacy: bool = True, paren_negative: bool = False) -> Column:
    """Digits, dots and hyphens are kept, the rest dropped.

    ``legacy``: a value without any of them is 0, not an error.  ``paren_negative``: (5) is -5.
    """
    kept = F.regexp_replace(c, "[^0-9.-]", "")
    value = F.when(kept.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), kept.try_cast("double"))
    if paren_negative:
        value = F.when(strip(c).rlike(r"^\(.*\)$"), -value).otherwise(value)
    return F.when(blank(c), F.lit(None).cast("double")).when(kept == "", F.lit(0.0 if legacy else None).cast("double")).otherwise(value)


def to_integer(c: Column, legacy: bool = True, zero: bool | None = None) -> Column:
    """Digits and hyphens are kept: with ``legacy`` the point goes too, so 12.5 is 125; without, it is an error.

    ``zero`` (``legacy`` if not given): a value without any digit is 0, not an error.
    """
    kept = F.regexp_replace(c, "[^0-9-]" if legacy else "[^0-9.-]", "")
    value = F.when(kept.rlike("^-?[0-9]+$"), kept.try_cast("bigint"))
    return F.when(blank(c), F.lit(None).cast("bigint")).when(kept == "", F.lit(0 if (legacy if zero is None else zero) else None).cast("bigint")).otherwise(value)


def to_timestamp(c: Column, day_first: bool = False) -> Column:
    """By the first format that the whole date part fits; ISO dates may have a time."""
    x = strip(c)
    formats = DAY_FIRST_FORMATS if day_first else DATE_FORMATS
    dated = [F.try_to_timestamp(x, F.lit(f)) for f in formats]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")], *dated)


def to_date(c: Column, day_first: bool = False) -> Column:
    return to_timestamp(c, day_first).cast("date")


def to_boolean(c: Column) -> Column:
    x = F.lower(strip(c))
    return F.when(x.isin(*TRUE), F.lit(True)).when(x.isin(*[b for b in BOOLEANS if b not in TRUE]), F.lit(False))


def to_text(c: Column, length: int | None = None) -> Column:
    """Stripped and cut to ``length`` (0 or None: not cut); blank is null."""
    x = F.nullif(strip(c), F.lit(""))
    return F.substring(x, 1, length) if length else x


def converted(c: Column, kind: str, length: int | None = None, legacy: bool = True, check_as_string: bool = False, zero: bool | None = None) -> Column:
    """By field type; ``legacy`` strips the point of integers, ``zero`` (``legacy`` if not given) takes values without digits for 0."""
    if kind in ("Currency", "Float"):
        return to_number(c, legacy if zero is None else zero)
    if kind == "Int":
        return to_integer(c, legacy, zero)
    if kind == "Date":
        return to_date(c)
    if kind == "Datetime":
        return to_timestamp(c)
    if kind == "Check" and not check_as_string:
        return to_boolean(c)
    if kind in ("Link", "Dynamic Link"):
        return to_text(c, 140)
    return to_text(c, length)


SPARK_TYPES = {"Currency": "double", "Float": "double", "Int": "bigint", "Date": "date", "Datetime": "timestamp", "Check": "boolean"}
