"""Document fingerprints: Merkle trees over blocks, paragraphs and sections, in built-in functions only.

A paragraph is a line; its leaves are its blocks of ``BLOCK`` code points.  A
section ends after an empty paragraph and after one whose hash ends in ``0``, so
sections are cut by content and an edit moves no border far away.  A paragraph's
hash is that of its leaves, a section's that of its paragraphs, the root that of
the sections.  Equal roots mean equal texts; where roots differ, the sections
and paragraphs whose hashes differ locate the edit.

A fingerprint is the root (64 hex digits), a colon, and the leaves (32 hex digits
each): blocks are joined by ``.``, paragraphs by ``,`` and sections by ``;``, so
that the inner hashes (64 hex digits) can be computed again and need no room.
:func:`compact` gives the short form, whose leaves have 8 hex digits and whose
root follows from these alone: different texts may share it, so it decides nothing.

Defined cases: null counts as the empty text, whose tree is one empty paragraph;
in :func:`pair_with_next` null keys come first, ordered by the hash of their text,
rows with equal keys are ordered by text, the last row is followed by the first, and a single row by itself; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a block, hex digits of a leaf, and of the leaves and inner hashes of the short form.
BLOCK, LEAF_DIGITS, SHORT_LEAF, SHORT_NODE = 64, 32, 8, 16
#: Rows wanted in a bucket of :func:`pair_with_next`, and the most buckets (two-level table of their borders).
BUCKET_ROWS, SIDE = 256, 64


def _node(x: Column) -> Column:
    return F.sha2(x, 256)


def _short_node(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, SHORT_NODE)


def _short(leaves: Column) -> Column:
    return F.regexp_replace(leaves, f"([0-9a-f]{{{SHORT_LEAF}}})[0-9a-f]{{{LEAF_DIGITS - SHORT_LEAF}}}", "$1")


def leaves_text(text: Column) -> Column:
    """The part of the fingerprint after the colon."""

    def paragraph(p: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda b: F.substring(F.sha2(b, 256), 1, LEAF_DIGITS)), ".")

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph)
    ended = F.transform(lines, lambda p: F.concat(p, F.when((p == "") | _short_node(_short(p)).endswith("0"), F.lit(";")).otherwise(F.lit(","))))
    joined = F.array_join(ended, "")
    return F.substring(joined, F.lit(1), F.length(joined) - 1)


def sections(body: Column, node: Callable[[Column], Column] = _node) -> Column:
    """Array of the sections' hashes, from the leaves."""
    return F.transform(F.split(body, ";", -1), lambda s: node(F.array_join(F.transform(F.split(s, ",", -1), node), ",")))


def fingerprint(body: Column) -> Column:
    return F.concat(F.sha2(F.array_join(sections(body), ","), 256), F.lit(":"), body)


def root(x: Column) -> Column:
    return F.substring_index(x, ":", 1)


def compact(x: Column) -> Column:
    """The short form of a fingerprint."""
    body = _short(F.substring_index(x, ":", -1))
    return F.concat(F.sha2(F.array_join(sections(body, _short_node), ","), 256), F.lit(":"), body)


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of different leaves that two fingerprints share, over the sum of their numbers; 1 for equal roots."""

    def leaves(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.substring_index(x, ":", -1), "[.,;]"), lambda v: v != ""))

    both, n = F.size(F.array_intersect(leaves(a), leaves(b))), F.size(leaves(a)) + F.size(leaves(b))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(F.coalesce(2.0 * both / F.nullif(n, F.lit(0)), F.lit(0.0)))


def differing(a: Column, b: Column) -> Column:
    """Hashes of the sections and paragraphs of fingerprint ``a`` that ``b`` lacks, with their places.

    Array of (section, paragraph, hash), counted from 0; only paragraphs of
    sections that ``b`` lacks are compared.
    """

    def body(x: Column) -> Column:
        return F.substring_index(x, ":", -1)

    def paragraphs(x: Column) -> Column:
        return F.transform(F.split(body(x), "[,;]", -1), _node)

    parts = F.arrays_zip(sections(body(a)).alias("h"), F.split(body(a), ";", -1).alias("t"))
    found = F.transform(
        parts,
        lambda s, i: F.when(
            ~F.array_contains(sections(body(b)), s["h"]),
            F.filter(
                F.transform(F.split(s["t"], ",", -1), lambda p, j: F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"), _node(p).alias("hash"))),
                lambda p: ~F.array_contains(paragraphs(b), p["hash"]),
            ),
        ),
    )
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<struct<section:int,paragraph:int,hash:string>>")).otherwise(F.flatten(F.filter(found, lambda x: x.isNotNull())))


def add_fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    return df.withColumn("_leaves", leaves_text(F.col(text))).withColumn(into, fingerprint(F.col("_leaves"))).drop("_leaves")


def pair_with_next(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """``key``, ``text`` and ``more`` with ``next_<name>`` of the row with the next greater (integer) key.

    Rows are dealt to buckets by ranges of the key (null keys by ranges of their text's hash), and the first rows of
    each bucket also go to the bucket before, so one shuffle of the rows and windows within buckets are enough.  The
    borders are approximate quantiles at every size, at most ``SIDE * SIDE`` of them, so a bucket holds a bounded
    share of the rows with different keys; the window spills if a bucket is large.
    """
    n, n_null = df.agg(F.count("*"), F.count(F.when(F.col(key).isNull(), 1))).first()
    wanted, wanted_null = (min(SIDE * SIDE, max(1, m // BUCKET_ROWS)) for m in (n - n_null, n_null))
    rows = df.select(key, text, *more).withColumn("_hash", F.when(F.col(key).isNull(), F.xxhash64(text)))
    found = sorted({int(x) for x in df.approxQuantile(key, [i / wanted for i in range(1, wanted)], 0.25 / wanted)}) if wanted > 1 else []
    side = max(1, int(len(found) ** 0.5))
    groups = [found[i : i + side] for i in range(0, len(found), side)]
    # The number of borders up to the key: whole groups first, then within the next one.
    if groups:
        coarse = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        g = F.size(F.filter(coarse, lambda x: x <= F.col(key)))
        bucket = F.when(g == 0, F.lit(0)).otherwise((g - 1) * side + F.size(F.filter(F.element_at(fine, F.greatest(g, F.lit(1))), lambda x: x <= F.col(key))))
    else:
        bucket = F.lit(0)
    # Buckets of null keys are negative, so they come first.
    of_null = F.least(F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * wanted_null), F.lit(wanted_null - 1)) - wanted_null
    at = F.when(F.col(key).isNull(), of_null).otherwise(bucket).cast("int")
    rows = rows.withColumn("_bucket", at)
    # The first key and hash of each bucket that has rows; as many rows as there are buckets.
    firsts = rows.groupBy("_bucket").agg(F.min(key).alias("_first"), F.min("_hash").alias("_first_hash"))
    order = Window.orderBy("_bucket")
    before = firsts.select("_first", "_first_hash", F.lag("_bucket").over(order).alias("_to"), F.max("_bucket").over(Window.partitionBy(F.lit(0))).alias("_last"))
    first = F.col(key).eqNullSafe(F.col("_first")) & F.col("_hash").eqNullSafe(F.col("_first_hash"))
    guards = rows.join(F.broadcast(before), first).select(key, text, *more, "_hash", F.coalesce("_to", "_last").alias("_bucket"), F.when(F.col("_to").isNull(), 2).otherwise(1).alias("_guard"))
    both = rows.withColumn("_guard", F.lit(0)).unionByName(guards)
    window = Window.partitionBy("_bucket").orderBy("_guard", key, "_hash", text)
    nexts = [F.lead(c).over(window).alias(f"next_{c}") for c in (key, text, *more)]
    return both.select(key, text, *more, "_guard", *nexts).filter("_guard = 0").drop("_guard")


def replace_half(text: Column, other: Column) -> Column:
    """The last floor(n / 2) code points of ``text`` replaced by the first as many (or all) of ``other``."""
    half = (F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
