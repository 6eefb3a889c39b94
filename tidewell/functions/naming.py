"""Names of columns, tables, records and files.

The four cleaners give different results by design.  Each has a form for
metadata (plain Python) and, where values are named, a Column form.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.strings import blank, strip

#: Fixed values.
KEYWORDS = ("class", "def", "return", "if", "else", "for", "while", "try", "except", "import", "from", "pass", "break", "continue")
RESERVED = ("name", "owner", "creation", "modified", "modified_by", "docstatus", "idx", "parent", "parentfield", "parenttype")
HEADER_ALIASES = {
    "e_mail": "email", "e-mail": "email", "emailid": "email",
    "cust_id": "customer_id", "custid": "customer_id",
    "phone_no": "phone", "mobile_no": "phone", "contact": "phone",
    "comp_name": "company_name", "organization": "company_name",
}
TABLE_ALIASES = {"Vendor": "Supplier", "Vendors": "Supplier", "Customers": "Customer", "Items": "Item", "Products": "Item", "Suppliers": "Supplier"}
RECORD_PREFIXES = {"Supplier": "SUP", "Customer": "CUST", "Contact": "CONT", "Lead": "LEAD", "Item": "ITEM"}
RESERVED_SQL = ("user", "select", "insert", "delete", "update", "drop", "create", "alter")

# ---- cleaners of names


def snake(x: str) -> str:
    """Runs of other characters than a-z and 0-9 become one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", x.lower()).strip("_")


def snake_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def field_name(x: str | None) -> str:
    """A safe field name: never empty, a single character, a number first, a keyword or a reserved name."""
    out = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", (x or "").strip().lower())).strip("_")
    if not out:
        return "field"
    if out[0].isdigit() or len(out) == 1:
        out = f"field_{out}"
    if out in KEYWORDS:
        return f"{out}_field"
    return f"custom_{out}" if out in RESERVED else out


def field_name_column(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    safe = F.when(base.rlike("^([0-9].*|.)$"), F.concat(F.lit("field_"), base)).otherwise(base)
    named = F.when(safe.isin(*KEYWORDS), F.concat(safe, F.lit("_field"))).when(safe.isin(*RESERVED), F.concat(F.lit("custom_"), safe)).otherwise(safe)
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("field")).otherwise(named)


def identifier(x: str, most: int = 140) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", x.lower())).strip("_")[:most]


def identifier_column(c: Column, most: int = 140) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", ""), 1, most)


def plain(x: str, dots: bool = False) -> str:
    """Lower case; blanks and hyphens (and dots) become underscores, one for one."""
    return x.lower().translate(str.maketrans(" -." if dots else " -", "___" if dots else "__"))


def plain_column(c: Column) -> Column:
    return F.translate(F.lower(c), " -", "__")


def label(x: str) -> str:
    return " ".join(w.capitalize() for w in re.split(r"[ _-]+", x) if w)


def normal_headers(headers: list[str]) -> list[str]:
    """Without byte-order marks, trimmed, lower case, common variants unified; repeats get a number."""
    out: list[str] = []
    for h in headers:
        h = h.replace("﻿", "").strip().lower()
        h = HEADER_ALIASES.get(h, h)
        n = sum(o == h or re.fullmatch(re.escape(h) + r"_\d+", o) is not None for o in out)
        out.append(f"{h}_{n + 1}" if n else h)
    return out


def table_name(path: str, known: tuple[str, ...] = (), drop_data_words: bool = True) -> str:
    """A table's name from a file's: words capitalised, one trailing version word dropped, known aliases used."""
    stem = re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", path)[-1])
    words = re.sub(r"[^A-Za-z0-9]+", " ", stem).split()
    tail = {"updated", "update", "updted", "new", "final", "latest", "copy"} | ({"data", "import"} if drop_data_words else set())
    if len(words) > 1 and words[-1].lower() in tail:
        words.pop()
    out = " ".join(w.capitalize() for w in words)[:61].strip()
    if TABLE_ALIASES.get(out) in known:
        return TABLE_ALIASES[out]
    if not out:
        return "Custom Import Data"
    return f"Import {out}" if out[0].isdigit() else out


def table_name_errors(name: str) -> list[str]:
    out = []
    if not name or len(name) > 61:
        out.append("a name has 1 to 61 characters")
    if not re.match(r"^[A-Za-z][A-Za-z0-9 _-]*$", name or ""):
        out.append("a name starts with a letter and holds letters, digits, blanks, _ and -")
    if (name or "").lower() in RESERVED_SQL:
        out.append("the name is a reserved word")
    return out


def file_name(x: str) -> str:
    """The last part of a path without unsafe characters, 255 characters at most with its extension kept."""
    x = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", re.split(r"[/\\]", x)[-1])
    if len(x) <= 255:
        return x
    stem, dot, extension = x.rpartition(".")
    return f"{stem[: 254 - len(extension)]}.{extension}" if dot else x[:255]


# ---- names of records


def numbered_base(c: Column) -> Column:
    """What counters are put behind: other characters become hyphens; 130 characters at most."""
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-"), 1, 130)


def short_base(c: Column) -> Column:
    """A shorter form that keeps blanks and drops other characters: 50 characters at most, never empty."""
    cut = F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9_\s-]", ""), 1, 50)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unnamed")).when(cut == "", F.lit("Record")).otherwise(cut)


def record_name(c: Column, table: str, fallback: Column | None = None) -> Column:
    """From an identifier: long digit runs keep their last eight, all else its safe characters; a blank one gets ``fallback``."""
    prefix = RECORD_PREFIXES.get(table, "REC")
    fallback = fallback if fallback is not None else F.concat(F.lit(f"{table}-{uuid.uuid4().hex[:4]}"), F.monotonically_increasing_id().cast("string"))
    value = strip(c)
    return (
        F.when(blank(c), fallback)
        .when(value.rlike("^[0-9]{9,}$"), F.concat(F.lit(f"{prefix}-"), F.right(value, F.lit(8))))
        .otherwise(F.substring(F.regexp_replace(value, "[^a-zA-Z0-9_-]", ""), 1, 140))
    )


#: What a field that may name a record is called, and how much it says.
NAMING = (
    (100, ("vin", "code", "serial", "number", "id")),
    (90, ("reference", "ref_no", "invoice", "order", "voucher", "receipt")),
    (85, ("email", "phone", "mobile", "tax_id", "pan", "gstin")),
    (70, ("name", "title", "label", "description")),
)


def naming_score(field: str) -> int:
    """How well a field names its record (0: not at all); containment either way counts, equality adds 10."""
    x = re.sub(r"[ _-]", "", field.lower())
    best = 0
    for score, words in NAMING:
        for w in (w.replace("_", "") for w in words):
            if w in x or x in w:
                best = max(best, score + 10 * (w == x))
    return best


def meaningful_name(columns: list[str], table: str, fallback: Column) -> Column:
    """Each record's name from its best field that isn't blank; fields are ranked once, as metadata."""
    ranked = sorted((c for c in columns if naming_score(c) >= 70), key=lambda c: (-naming_score(c), columns.index(c)))
    value = lambda c, n: F.substring(F.regexp_replace(strip(F.col(f"`{c}`")), "[^a-zA-Z0-9_-]", "-"), 1, n)
    usable = lambda v: F.when(F.length(v) >= 2, v)
    short = re.sub(" ", "", table.lower())[:5]
    first = [F.when(~blank(F.col(f"`{c}`")), usable(value(c, 140))) for c in ranked]
    rest = [F.when(~blank(F.col(f"`{c}`")), F.concat(F.lit(f"{short}-"), usable(value(c, 40)))) for c in columns if c.lower() not in ("id", "modified", "created")]
    return F.coalesce(*first, *rest, F.concat(F.lit(f"{short}-"), fallback))
