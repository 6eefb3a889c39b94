"""Proposals of a target from a file's name and fields, and mappings for fields without a known table."""

from __future__ import annotations

import re
from collections import Counter

from tidewell.functions.messages import CONTEXT_WORDS
from tidewell.functions.naming import plain, table_name

#: Words in a file's name and the tables they stand for; words in a header and the usual field.
FILE_WORDS = (("customer", "Customer"), ("supplier", "Supplier"), ("vendor", "Supplier"), ("item", "Item"), ("product", "Item"), ("invoice", "Sales Invoice"), ("payment", "Payment Entry"))
USUAL_FIELDS = {
    "customer": "customer_name", "supplier": "supplier_name", "vendor": "supplier_name",
    "item": "item_name", "product": "item_name", "email": "email_id", "phone": "mobile_no", "mobile": "mobile_no",
    "address": "address_line1", "city": "city", "state": "state", "country": "country",
    "total": "grand_total", "amount": "amount", "quantity": "qty", "rate": "rate", "date": "date",
}
RESERVED_TABLES = ("User", "Role", "DocType", "File", "Email", "SMS", "Settings", "Permission")
CONFUSING_ENDINGS = ("updated", "updted", "new", "final", "latest", "copy")
SURE, NAMED, UNSURE = 0.75, 0.8, 0.5


def context(header: str) -> str:
    """The business context of one header."""
    low = header.lower()
    return next((name for name, words in CONTEXT_WORDS if any(w in low for w in words)), "General")


def propose_target(file: str, headers: list[str]) -> tuple[str, float, bool]:
    """(table, confidence, needs confirmation): the better of the file's name and the most frequent context of its headers."""
    low = file.lower()
    found = [(t, NAMED) for w, t in FILE_WORDS if w in low][:1]
    if headers:
        name, n = Counter(map(context, headers)).most_common(1)[0]
        found.append((name, n / len(headers)))
    target, confidence = max(found, key=lambda x: x[1]) if found else (table_name(file), UNSURE)
    return target, confidence, confidence < SURE


def usual_field(header: str) -> str | None:
    low = header.lower()
    return next((f for w, f in USUAL_FIELDS.items() if w in low), None)


def propose_mapping(headers: list[str], fields: list[str], clean) -> dict[str, str]:
    """Exact cleaned names first, then the usual field, then the cleaned name."""
    return {h: c if (c := clean(h)) in fields else usual_field(h) or c for h in headers}


def similar_field(name: str, fields: list[str], least: float = 0.7) -> str | None:
    """Equal but for case, then contained either way, then with the most equal characters at equal places."""
    low = name.lower()
    for test in (lambda f: f == low, lambda f: low in f or f in low):
        if found := next((f for f in fields if test(f.lower())), None):
            return found
    share = {f: sum(a == b for a, b in zip(low, f.lower(), strict=False)) / max(len(low), len(f), 1) for f in fields}
    best = max(share, key=share.get, default=None)
    return best if best is not None and share[best] > least else None


def map_record(keys: list[str], fields: list[str], clean) -> dict[str, str]:
    """Keys of a foreign record to fields; those without any are left out."""
    out = {k: c if (c := clean(k)) in fields else similar_field(c, fields) for k in keys}
    return {k: f for k, f in out.items() if f}


def registry_mapping(stored: dict[str, str] | None, headers: list[str]) -> dict[str, str]:
    """The stored mapping of a registered schema, else plain names."""
    return stored or {h: plain(h) for h in headers}


def table_name_warnings(name: str) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a proposed table's name."""
    errors = [] if len(name) <= 61 else ["a name has at most 61 characters"]
    if name in RESERVED_TABLES:
        errors.append(f"{name} is reserved")
    warnings = ["characters that aren't safe will be replaced"] if re.search(r"[^\w\s-]", name) else []
    url = name.lower().replace(" ", "-")
    if len(url) > 1 and not re.match(r"^[a-z][a-z0-9-]*[a-z0-9]$", url):
        warnings.append("the name isn't safe in addresses")
    if name.lower().endswith(CONFUSING_ENDINGS):
        warnings.append("the ending may confuse")
    return errors, warnings
