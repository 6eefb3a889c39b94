"""Strings as data: blanks, trims, Python's truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0b"


def strip(c: Column | str) -> Column:
    """White space (ASCII) off both ends; SQL's trim takes blanks only, and Java's ``$`` stands before a last line separator too."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def blank(c: Column | str) -> Column:
    """Null or nothing but white space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (strip(c) == "")


def null_or_empty(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def filled(c: Column | str) -> Column:
    """The stripped value, null if blank."""
    return F.nullif(strip(c), F.lit(""))


def truthy(c: Column | str, kind: str = "string") -> Column:
    """The value where Python takes it for true, else null: no empty text, 0, 0.0 or false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != {"string": F.lit(""), "boolean": F.lit(False)}.get(kind, F.lit(0)), c)


def json_map(c: Column) -> Column:
    """A JSON object as a map of texts; null if it can't be read."""
    return F.from_json(c, "map<string,string>")


def like_escaped(c: Column, text: str) -> Column:
    """``text`` stands in ``c``, with ``%`` and ``_`` taken as they are."""
    return c.contains(text)


def any_word(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Any of the (plain) words stands in ``c``."""
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found
