"""Near copies by bottom-k sketches of one hash function.

A document's set holds its distinct word shingles; its sketch is the ``k`` least
hash values of the set, all of them if there are no more.  Of two sets the ``k`` least values of both
sketches together are a sample of the sets' union, and the share of it that both sketches
hold estimates their similarity.  :func:`need` is the number of values of that
sample that similar sets have in common but for a chance of ``MISS``; where both sketches
are whole sets the bound is exact, without a chance.

Similar sets thus share so many retained values that, with each sketch's values in the order of their number of
lists members (rarest first), they share one of the first ``size - least overlap + 1``.  Only those go into inverted
lists, so passages that many documents have in common make no long lists unless a sketch holds little else.
Equal sets are one class, so copies make no lists.

The values are counted in parts of their range.  A chunk of classes gives one row of packed numbers for each part: the upper 48 bits of
the values and the classes' places in the chunk; of values that many of a chunk's classes retain it gives the number alone, and their
members meet the counts in a join.  Values that agree in those bits count as one, and of sketches that are compared the upper 32 bits count: either can
add a list or a candidate and takes none away, since equal values stay equal and in order.

Members of a list are compared with two representatives.  What links don't connect then is dealt to cells of bounded size: the
overlap is bounded by parity bits of the sketches, the union's sketch estimates, and the members that may have a link
get their texts.  Every link is confirmed on full sets.  A cell gives a spanning
forest of its links.

Defined cases: texts without words have the empty set and are linked with nothing; a null key
takes part (a component's id is its least key that isn't null, if there is one); rows that share a key or text are
linked as other rows are; texts of any length count whole; an empty table gives an empty table; other
columns are not looked at, whatever their names.  Words, shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SLICE_ROWS, Workspace, texts
from tidewell.llm.components import components
from tidewell.llm.jaccard import BLOCK, CACHE_CLASSES, ODD, OWNERS, Shingles, _joined, _ordered, first_rows, forests, mix, set_hash, texts_of, verified, whole_cells

WORDS, PERCENT = 4, 80
#: Retained values; the chance that a similar pair of larger sets shares fewer than :func:`need` of its union's.
K, MISS = 128, 1e-10
#: Parity bits of a sketch within a cell.
PARITY = 1024
#: Classes of a chunk; values of a part, as far as there are not more than ``MOST_PARTS``; members of a chunk from which on a value is common there.
CHUNK, PART_VALUES, MOST_PARTS, COMMON = 8192, 1 << 18, 1 << 15, 32


@functools.cache
def need(k: int, percent: int, miss: float = MISS) -> int:
    """The greatest number that a binomial variable of ``k`` trials at ``percent`` stays below with a chance of at most ``miss``."""
    p, below = percent / 100, 0.0
    for x in range(k + 1):
        below += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if below > miss:
            return x
    return k


@functools.cache
def least_overlap(size: int, k: int, percent: int) -> int:
    """Retained values that a set of ``size`` elements shares with any similar one."""
    whole = -(-percent * size // 100)
    if size > k:
        return need(k, percent)
    return whole if size * 100 // percent <= k else min(whole, need(k, percent))


def prefix(size: int, k: int, percent: int) -> int:
    """How many of a sketch's values go into inverted lists."""
    return min(size, k) - least_overlap(size, k, percent) + 1


def may_be_similar(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, k: int, percent: int) -> bool:
    """Whether the sketches leave it open that the sets are similar."""
    if 100 * min(size_a, size_b) < percent * max(size_a, size_b):
        return False
    both = np.sort(np.concatenate([a, b]))
    twice = both[:-1][both[1:] == both[:-1]]  # a value of both sketches
    if size_a <= k and size_b <= k:
        return (100 + percent) * len(twice) >= percent * (size_a + size_b)
    union = both[np.append(True, both[1:] != both[:-1])]
    last = union[min(k, len(union)) - 1]
    return int(np.searchsorted(twice, last, "right")) >= need(k, percent)


def sketched(df: DataFrame, words: int, k: int) -> DataFrame:
    """(key, h, n_shingles, set, high, low) of (key, h, text): the hash of the set, null for the empty one, and the upper 32 and next 16 bits of the sketch's values; a task gives a set's sketch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = Shingles(words).of, set()
        for batch in batches:
            sizes, ids, high, low = [], [], [], []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for t in texts(batch.column(2).slice(at, SLICE_ROWS)):
                    s = of(t)
                    h = set_hash(s) if len(s) else None
                    sizes.append(len(s))
                    ids.append(h)
                    new = h is not None and h not in seen
                    high.append((s[:k] >> np.uint64(32)).astype(np.uint32).tobytes() if new else None)
                    low.append((s[:k] >> np.uint64(16)).astype(np.uint16).tobytes() if new else None)
                    if len(seen) < CACHE_CLASSES:
                        seen.add(h)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(high, pa.binary()), pa.array(low, pa.binary())], ["key", "h", "n_shingles", "set", "high", "low"])

    return df.select("key", "h", "text").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, h long, n_shingles long, set long, high binary, low binary")


def planes(values: np.ndarray) -> bytes:
    """48-bit numbers as six rows of bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view("<u8").reshape(-1)


def packed(held: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """(part, base, v, at, least, often, n): a chunk's retained values of one part, sorted, with their classes (``base`` and a place) and the classes' least overlaps.

    ``often`` and ``n`` are the values that are common in the chunk and their numbers; their members are the row of part -1.
    """
    names = ["part", "base", "v", "at", "least", "often", "n"]

    def chunk(batch: pa.RecordBatch, base: int) -> pa.RecordBatch:
        sizes, high, low = (batch.column(c).to_pylist() for c in (1, 2, 3))
        held = [len(x) // 4 for x in high]
        v = np.frombuffer(b"".join(high), np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(b"".join(low), np.uint16)
        at = np.repeat((batch.column(0).to_numpy() - base).astype(np.uint16), held)
        least = np.repeat(np.array([least_overlap(x, k, percent) for x in sizes], np.uint16), held)
        part = mix(v) % np.uint64(parts)
        order = np.argsort(part << np.uint64(48) | v)
        v, at, least, part = v[order], at[order], least[order], part[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        n = np.diff(np.append(start, len(v)))
        some = n >= COMMON
        common, often, often_part, n = np.repeat(some, n), v[start][some], part[start][some], n[some]
        rows = [[-1, base, planes(v[common]), at[common].tobytes(), least[common].tobytes(), b"", b""]] if len(often) else []
        v, at, least, part = (x[~common] for x in (v, at, least, part))
        all_parts = np.union1d(part, often_part)
        cuts = [np.searchsorted(x, all_parts, side).tolist() for x in (part, often_part) for side in ("left", "right")]
        for p, a, b, c, d in zip(all_parts.tolist(), *cuts, strict=True):
            rows.append([p, base, planes(v[a:b]), at[a:b].tobytes(), least[a:b].tobytes(), planes(often[c:d]), n[c:d].tobytes()])
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column(0).to_numpy(), 0
            while first < len(ids):
                place = ids[first : first + CHUNK] - ids[first]
                fits = (place >= 0) & (place < 1 << 16)  # another file's numbers are far away
                rows = len(place) if fits.all() else int(np.argmin(fits))
                yield chunk(batch.slice(first, rows), int(ids[first]))
                first += rows

    return held.select("class", "size", "high", "low").mapInArrow(run, "part int, base long, v binary, at binary, least binary, often binary, n binary")


def counted(rows: DataFrame) -> DataFrame:
    """(class, least, n, v) of packed rows: the values that several classes retain, and in how many; without a class the values that are common in some chunk."""

    def of_part(rows: list[dict]) -> pa.RecordBatch:
        v, often = (np.concatenate([from_planes(r[c]) for r in rows]) for c in ("v", "often"))
        ids = np.concatenate([np.frombuffer(r["at"], np.uint16) + np.int64(r["base"]) for r in rows])
        least = np.concatenate([np.frombuffer(r["least"], np.uint16) for r in rows])
        each, at = np.unique(np.append(v, often), return_inverse=True)
        n = np.bincount(at, minlength=len(each))
        np.add.at(n, at[len(v) :], np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows]) - 1)
        keep, common = n[at[: len(v)]] > 1, np.unique(at[len(v) :])
        none = np.append(np.zeros(keep.sum(), bool), np.ones(len(common), bool))
        columns = [np.append(ids[keep], common), np.append(least[keep].astype(np.int64), common), np.append(n[at[: len(v)][keep]], n[common]), np.append(v[keep], each[common]).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=none if i < 2 else None) for i, x in enumerate(columns)], ["class", "least", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []  # of one part
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["part"] != row["part"]:
                    yield of_part(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield of_part(rows)

    return rows.filter("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(run, "class long, least long, n long, v long")


def common_members(rows: DataFrame) -> DataFrame:
    """(v, class, least) of packed rows: the members of values that are common in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = [from_planes(row["v"]).astype(np.int64), np.frombuffer(row["at"], np.uint16) + np.int64(row["base"]), np.frombuffer(row["least"], np.uint16).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["v", "class", "least"])

    return rows.filter("part < 0").mapInArrow(run, "v long, class long, least long")


def lists(held: DataFrame, work: Workspace, k: int, percent: int) -> DataFrame:
    """(sig, class): the rarest values of each class's sketch, as far as others retain them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids = [], []
            for c, least, found in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                # Values that nobody else retains are the rarest: they come first and make no list.
                m = len(found) + 1 - least
                if m > 0:
                    sigs += [x["v"] for x in found[:m]]
                    ids += [c] * min(m, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(ids, pa.int64())], ["sig", "class"])

    rows = packed(held, k, percent, max(1, min(MOST_PARTS, -(-held.count() * k // PART_VALUES))))
    shared = work.write(counted(rows), "shared")
    found, often = shared.filter("class is not null"), shared.filter("class is null").select(F.col("v").alias("w"), "n")
    if not often.isEmpty():
        found = found.unionByName(common_members(rows).join(often, F.col("v") == F.col("w")).select("class", "least", "n", "v"))
    out = found.repartition("class").groupBy("class", "least").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("found")).mapInArrow(run, "sig long, class long")
    out = work.write(out, "rarest")
    work.drop("shared")
    return out


def groups(rows: DataFrame) -> DataFrame:
    """(sig, class, first, last, n) of the lists with several members; of lists with the same members one stays. ``first``, ``last``: the least and the greatest member."""
    head = rows.groupBy("sig").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("all")).filter("n > 1")
    one = head.groupBy("first", "last", "n", "all").agg(F.min("sig").alias("s")).select("s", "first", "last", "n")
    return rows.join(one, F.col("sig") == F.col("s")).select("sig", "class", "first", "last", "n")


def estimated(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the estimate leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in (2, 3)]
            mins = [[np.frombuffer(m, np.uint32) for m in batch.column(c).to_pylist()] for c in (4, 5)]
            keep = pa.array([may_be_similar(a, b, m, n, k, percent) for a, b, m, n in zip(*mins, *sizes, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    one, two = (held.select(F.col("class").alias(f"_{x}"), F.col("size").alias(f"size_{x}"), F.col("high").alias(f"mins_{x}")) for x in "ab")
    sized = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).filter(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    return sized.select("a", "b", "size_a", "size_b", "mins_a", "mins_b").mapInArrow(run, "a long, b long")


def in_cells(open_groups: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """The members (sig, class, root, n) of lists dealt to cells of bounded size: any two blocks of a list meet in one.

    ``least`` are the class's least lists, in order.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = open_groups.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sigs = open_groups.groupBy(F.col("class").alias("c")).agg(F.slice(F.array_sort(F.collect_list("sig")), 1, OWNERS).alias("least"))
    known = held.select(F.col("class").alias("k"), "size", F.col("high").alias("mins")).join(sigs, F.col("k") == F.col("c"))
    return other.join(known, F.col("class") == F.col("k")).select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "class", "root", "size", "mins", "own", "least")


def parity(values: np.ndarray) -> np.ndarray:
    """``PARITY`` bits; each value flips one.  Two sketches differ in at least as many values as bits."""
    odd = np.bincount((mix(values ^ ODD[2]) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def candidates_within(cells: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows (sig, lo, hi, class, root) that may have a link to one of another root in their cell; no more than the cell's rows.

    A pair is looked at in the cell of the least list that both are known to share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches):
            start = first_rows(t)
            roots, sizes, own = (t.column(c).to_numpy() for c in ("root", "size", "own"))
            same = t.column("lo").to_numpy() == t.column("hi").to_numpy()
            mins = [np.frombuffer(m, np.uint32) for m in t.column("mins").to_pylist()]
            bits, held = np.stack([parity(m.astype(np.uint64)) for m in mins]), np.array([len(m) for m in mins])
            wanted, sigs, least_of = np.zeros(len(mins), bool), t.column("sig").to_pylist(), [frozenset(x) for x in t.column("least").to_pylist()]
            for i in range(1, len(mins)):
                j = np.arange(start[i], i)
                j = j[(roots[j] != roots[i]) & (same[i] | (own[j] != own[i])) & ~(wanted[i] & wanted[j])]
                j = j[100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])]
                least = np.where((sizes[j] <= k) & (sizes[i] <= k), -(-percent * (sizes[j] + sizes[i]) // (100 + percent)), need(k, percent))
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) <= held[i] + held[j] - 2 * least]
                for x in j.tolist():
                    if not (wanted[i] and wanted[x]) and min(least_of[i] & least_of[x], default=sigs[i]) >= sigs[i] and may_be_similar(mins[i], mins[x], int(sizes[i]), int(sizes[x]), k, percent):
                        wanted[i] = wanted[x] = True
            if wanted.any():
                yield t.select(["sig", "lo", "hi", "class", "root"]).filter(pa.array(wanted))

    rows = cells.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return rows.mapInArrow(run, "sig long, lo int, hi int, class long, root long")


def link(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, k: int = K, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) and kept (whether that is the row's own) of every row."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    own = work.write(sketched(rows, words, k), "classes")
    known = own.filter("set is not null")
    sketches = [F.first(c, ignorenulls=True).alias(c) for c in ("high", "low")]
    first = known.groupBy("set").agg(F.min(F.struct("key", "h")).alias("rep"), F.min("key").alias("key"), F.first("n_shingles").alias("size"), *sketches)
    # From here on a class is a number that stands in this table; numbers of a file follow one another.
    held = work.write(first.withColumn("class", F.monotonically_increasing_id()), "held")
    open_groups = work.write(groups(lists(held, work, k, percent)), "lists-0")
    work.drop("rarest")

    def text_of(classes: DataFrame, name: str) -> DataFrame:
        return work.write(texts_of(rows, held.select("class", "rep").join(classes.distinct(), "class")), f"texts-{name}")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        left = work.write(estimated(pairs, held, k, percent), f"pairs-{name}")
        out = work.write(verified(left, text_of(left.select(F.explode(F.array("a", "b")).alias("class")), name), words, percent), f"links-{name}")
        for part in ("pairs", "texts"):
            work.drop(f"{part}-{name}")
        return out

    ends = open_groups.select("class", F.explode(F.array("first", "last")).alias("head"))
    links = compared(_ordered(ends, "class", "head"), "0")
    roots = components(links, work, "roots-0")
    # Lists that links don't connect as a whole, with the components; the only pair of a list of two has been compared, and the pairs of three but one.
    rooted = open_groups.filter("n > 2").select("sig", "class", "n").join(roots, F.col("class") == F.col("node"), "left").select("sig", "class", "n", F.coalesce("root", "class").alias("root"))
    apart = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select(F.col("sig").alias("s"))
    open_groups = work.write(rooted.join(apart, F.col("sig") == F.col("s")).drop("s"), "lists-1")
    if not open_groups.isEmpty():
        members = work.write(candidates_within(in_cells(open_groups, held, block), k, percent), "members")
        more = work.write(forests(members, text_of(members.select("class"), "cells"), words, percent), "links-cells")
        roots = roots if more.isEmpty() else _joined(roots, more, work, 1)

    labels = held.select("class", "set", "key").join(roots, F.col("class") == F.col("node"), "left").select("set", F.coalesce("root", "class").alias("root"), "key")
    least = labels.groupBy("root").agg(F.min("key").alias("component_id"))
    component = work.write(labels.select("set", "root").join(least, "root").select(F.col("set").alias("s"), "component_id"), "components")
    for name in ("held", "lists-0", "lists-1", "members", "texts-cells"):
        work.drop(name)
    linked = known.join(component, F.col("set") == F.col("s")).select("key", "n_shingles", "component_id")
    alone = own.filter("set is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
