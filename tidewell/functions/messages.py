"""Kinds of errors and business contexts, from words that stand in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.strings import any_word

#: The first category with a word in the message holds.
ERROR_WORDS = (
    ("security", "high", ("permission", "unauthorized", "forbidden", "security")),
    ("validation", "medium", ("invalid", "required", "missing", "format")),
    ("resource", "high", ("memory", "disk", "space", "timeout", "resource")),
    ("database", "high", ("database", "sql", "connection", "duplicate")),
    ("file_processing", "medium", ("file", "csv", "excel", "path", "encoding")),
    ("network", "medium", ("network", "connection", "timeout", "url")),
    ("configuration", "medium", ("config", "setting", "parameter")),
)
CONTEXT_WORDS = (
    ("Customer", ("customer", "client", "buyer")),
    ("Supplier", ("vendor", "supplier", "seller")),
    ("Item", ("product", "item", "inventory")),
    ("Address", ("address", "location", "city", "state")),
    ("Accounting", ("invoice", "bill", "payment")),
)
ADVICE = {
    "security": "Check the permissions of the user and of the target.",
    "validation": "Correct the values that the message names and import the rows again.",
    "resource": "Give the job more memory or disk, or import fewer files at once.",
    "database": "Check the target table and that its keys are unique.",
    "file_processing": "Check the file's path, format and encoding.",
    "network": "Check the address and try again.",
    "configuration": "Check the settings.",
    "system": "See the log.",
}


def _first(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    low, out = F.lower(text), F
    for value, words in rules:
        out = out.when(any_word(low, words), F.lit(value))
    return out.otherwise(F.lit(otherwise))


def error_category(message: Column) -> Column:
    return _first(message, [(c, w) for c, _, w in ERROR_WORDS], "system")


def error_severity(message: Column) -> Column:
    return _first(message, [(s, w) for _, s, w in ERROR_WORDS], "medium")


def error_advice(message: Column) -> Column:
    return _first(message, [(ADVICE[c], w) for c, _, w in ERROR_WORDS], ADVICE["system"])


def business_context(text: Column) -> Column:
    return _first(text, list(CONTEXT_WORDS), "General")


class ImportFailure(Exception):
    """An import that can't go on; ``category`` and ``severity`` as for messages."""

    def __init__(self, message: str, category: str | None = None, severity: str | None = None):
        super().__init__(message)
        low = message.lower()
        found = next(((c, s) for c, s, w in ERROR_WORDS if any(x in low for x in w)), ("system", "medium"))
        self.category, self.severity = category or found[0], severity or found[1]
        self.advice = ADVICE[self.category]
