"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles.  Sizes fall into bands so
that a set and a similar smaller one are in the same or in neighbouring bands;
each set takes part in its own band and in the next.  Two sets of a band that are
similar enough differ in at most k elements.  PartEnum deals the feature domain by
hash into n1 first-level partitions of n2 second-level ones; at least one first-level
partition then differs in at most k2 of its n2, and a signature is made of the
elements in each of the subsets of n2 - k2 of them, so the two sets share one.
:func:`parts` gives the parameters of a band: one first-level partition of k + 2 for
short texts (k up to ``ENUMERATE``), where subsets keep signatures long, and k + 1 + e
that stand alone (n2 = 1) for longer ones, where enumeration makes more signatures
and larger groups.  A signature without elements would be shared by many unlike
sets.  Two sets agree in at least 1 + e first-level partitions; so if a set has more
than e in which a subset is empty, it is dealt anew by another hash, and so is
any set that agrees with it in empty ones only.  No similar pair is missed.

Equal sets are one class from the start.  Classes that share a signature are
compared in exact rounds: first every member of a signature's group with one
representative, then, as far as links don't connect them yet, with the member that
has most links.  Members of groups that are still apart are dealt to cells of bounded
size; a cell looks at pairs as sketches first, each pair in the cell of the least
signature that both have.  The few members that may have a link there get their
texts, and a cell gives a spanning forest of its links: fewer rows than members.

A parity sketch has about as many bits as the set has elements, and each element
flips one.  Two sketches differ in at most as many bits as the sets in elements, so
a pair whose sketches differ in more than k bits isn't similar.

Defined cases: texts without words have the empty set and are linked with
nothing; a null key takes part (a component's id is its least key that isn't
null, if there is one); rows that share a key or text are linked as other rows
are; texts of any length count whole; an empty table gives an empty table; other
columns are not looked at, whatever their names.  Words, shingles and sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SLICE_ROWS, Workspace, texts
from tidewell.llm.components import components

WORDS, PERCENT = 5, 80
#: Bands whose sets differ in at most so many elements enumerate subsets of partitions; hashes that sets are dealt by before an empty subset counts.
ENUMERATE, LEVELS = 6, 16
CACHE_CLASSES = 1_000_000
#: Classes whose texts are looked up by a broadcast of their keys (some 24 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rounds up to the cells; members and shingles of a group that meet in one block of a cell.
STARS, BLOCK, BLOCK_SHINGLES = 2, 2048, 1 << 20
#: Pairs of sketches that are compared at a time; signatures of a member that tell which cell a pair belongs to.
PAIRS, OWNERS = 200_000, 24

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well spread (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


#: Texts are hashed by array operations in parts of at most so many bytes; longer words are hashed by themselves.
ARRAY_BYTES, WORD_BYTES = 1 << 16, 32


@functools.cache
def _table() -> np.ndarray:
    """A random value for each place in a word and byte."""
    return mix(mix(np.arange(1, 256 * WORD_BYTES + 1, dtype=np.uint64) * ODD[1]) + ODD[3])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of at most ``ARRAY_BYTES`` bytes of lower-case text: the sum of its bytes' values."""
    b = np.frombuffer(data, np.uint8)
    letter = np.zeros(len(b) + 2, np.int8)
    letter[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    at, first = np.flatnonzero(letter[1:-1]), np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    long = np.flatnonzero(size > WORD_BYTES)
    if len(long):
        np.minimum(place, WORD_BYTES - 1, out=place)
    out = mix(np.add.reduceat(_table()[(place << 8) | b[at]], first))
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return out


def all_hashes(data: bytes) -> np.ndarray:
    """The same for texts and words of any length: cut at white space; a word beyond the bound is hashed by itself."""
    if len(data) <= ARRAY_BYTES:
        return word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = at + ARRAY_BYTES
        if end < len(data):
            end = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end > at or (end == at and at + 1 == len(data)):
            out.append(word_hashes(data[at:end]))
        elif end < 0 or data[at : at + 1].strip():
            word = data[at:].split(None, 1)[0]
            end = at + len(word)
            out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64) if len(word) > WORD_BYTES else word_hashes(word))
        else:
            end = at + 1
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Shingles:
    """Sorted 64-bit hashes of the distinct shingles of texts."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.odd = ODD if words == WORDS else np.resize(ODD, words) + np.arange(words, dtype=np.uint64) * np.uint64(2)

    def of(self, text: str) -> np.ndarray:
        x = all_hashes(text.encode().lower())
        if len(x) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), 1)] if len(x) else [], np.uint64)
        n = len(x) - self.words + 1
        out = x[:n] * self.odd[0]
        for k in range(1, self.words):
            out += x[k : k + n] * self.odd[k]
            out ^= out >> np.uint64(31)
        out = mix(out)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def set_hash(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


@functools.cache
def band(i: int, percent: int) -> tuple[int, int]:
    """Least and greatest size of band ``i``."""
    least = 1 if i == 0 else band(i - 1, percent)[1] + 1
    return least, least * 100 // percent


@functools.cache
def band_of(size: int, percent: int) -> int:
    i = 0
    while band(i, percent)[1] < size:
        i += 1
    return i


@functools.cache
def parts(i: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, e) for the sets that meet in band ``i``: those of this band and of the one before."""
    low, high = band(max(0, i - 1), percent)[0], band(i, percent)[1]
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    if k <= ENUMERATE:
        return 1, k + 2, k, 0
    e = 0
    while True:
        n = k + 1 + e
        void = n * (1 - 1 / n) ** low
        if e >= void + 2 * void**0.5 or e > low:
            return n, 1, 0, e
        e += 1


@functools.cache
def subsets(n2: int, k2: int) -> np.ndarray:
    """One row of ``n2`` flags for each subset of n2 - k2 partitions."""
    return np.array([[c in s for c in range(n2)] for s in itertools.combinations(range(n2), n2 - k2)])


@functools.cache
def _salts(i: int, percent: int, level: int) -> np.ndarray:
    """A number for each first-level partition and subset of band ``i``."""
    n1, n2, k2, _ = parts(i, percent)
    n = n1 * len(subsets(n2, k2))
    return mix(np.arange(n, dtype=np.uint64) + np.uint64((i + 1 << 32) + (level << 56))).reshape(n1, -1)


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """64-bit signatures of a set that isn't empty."""
    out, own = [], band_of(len(shingles), percent)
    for i in (own, own + 1):
        n1, n2, k2, e = parts(i, percent)
        n, chosen = n1 * n2, subsets(n2, k2)
        for level in range(LEVELS):
            dealt = shingles if level == 0 else mix(shingles ^ np.uint64(level << 40))
            value, at = mix(dealt + np.uint64(1)), (dealt % np.uint64(n)).astype(np.int64)
            low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
            held = np.bincount(at, minlength=n).reshape(n1, n2) > 0
            # The sum of the elements' mixed values, modulo 2**64; halves are summed apart, so the sums are exact.
            total = (np.bincount(at, low, n).astype(np.uint64) + (np.bincount(at, high, n).astype(np.uint64) << np.uint64(32))).reshape(n1, n2)
            if n2 > 1:
                held, total = (held[:, None, :] & chosen).any(2), np.where(chosen, total[:, None, :], np.uint64(0)).sum(2, dtype=np.uint64)
            sig, done = mix(total ^ _salts(i, percent, level)), n1 - held.all(1).sum() <= e
            out.append(sig.reshape(-1) if level == LEVELS - 1 and not done else sig[held])
            if done:
                break
    return np.concatenate(out)


def classes_of(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, h, n_shingles, class, bits) of (key, h, text): the class is the hash of the set, null for the empty set; bits are its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of
        for batch in batches:
            sets = [of(t) for at in range(0, batch.num_rows, SLICE_ROWS) for t in texts(batch.column(2).slice(at, SLICE_ROWS))]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["key", "h", "n_shingles", "class", "bits"])

    return df.select("key", "h", "text").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, h long, n_shingles long, class long, bits binary")


def signed(df: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, class) of all sets that aren't empty; a task signs equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = Shingles(words).of, set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                sigs, ids = [], []
                for t in texts(batch.column(0).slice(at, SLICE_ROWS)):
                    s = of(t)
                    if len(s) and (h := set_hash(s)) not in seen:
                        if len(seen) < CACHE_CLASSES:
                            seen.add(h)
                        sigs.append(signatures(s, percent))
                        ids.append(h)
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(s) for s in sigs]))], ["sig", "class"])

    return df.select("text").mapInArrow(run, "sig long, class long")


def groups(rows: DataFrame) -> DataFrame:
    """(sig, class, first) of the signatures that several classes share; ``first`` is the group's least class.

    Rows come sorted by signature, so a group's rows stand next to each other and none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # the last row seen, if it may still get company
        first, emitted = 0, False  # of the group of that row
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.append(held[0], batch.column(0).to_numpy())
            ids = np.append(held[1], batch.column(1).to_numpy())
            new = np.append(True, sig[1:] != sig[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
            lead = ids[start]
            if held.shape[1]:
                lead[start == 0] = first
            # A row stays if the one before or after it has its signature and another class; repeats of a row go.
            repeat = np.append(False, ~new[1:] & (ids[1:] == ids[:-1]))
            more = ids != lead
            group = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
            shared = np.zeros(len(sig), bool)
            shared[group[more]] = True
            keep = (more | (new & shared)) & ~repeat
            if held.shape[1]:
                keep[0] = shared[0] and not emitted and ids[0] == first
                emitted_now = emitted or bool(shared[0])
            else:
                emitted_now = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(ids[keep]), pa.array(lead[keep])], ["sig", "class", "first"])
            last = start[-1]
            emitted = (emitted_now if last == 0 and held.shape[1] else False) or bool(shared[last])
            first, held = int(lead[-1]), np.array([sig[-1:], ids[-1:]])

    return rows.repartition("sig").sortWithinPartitions("sig", "class").mapInArrow(run, "sig long, class long, first long")


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits: a power of two of them, at least 64 and as many as elements; half as many come from both halves' exclusive or."""
    m = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles ^ ODD[2]) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """One row of 64-bit words for each sketch, all of ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, x in enumerate(sketches):
        v = np.frombuffer(x, np.uint64)
        while len(v) * 8 > size:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def may_be_similar(bits: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes whose sketches differ in ``bits`` bits can be similar."""
    return (bits * (100 + percent) <= (size_a + size_b) * (100 - percent)) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))


def texts_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text): a text for each class of ``wanted`` (class, rep: key and h of one of its rows)."""
    keys = wanted.select(F.col("rep.h").alias("wanted_h"), F.col("rep.key").alias("wanted_key"), "class")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # Several rows may have the key and the text.
    found = df.join(keys, (F.col("h") == F.col("wanted_h")) & F.col("key").eqNullSafe(F.col("wanted_key")))
    return found.groupBy("class").agg(F.first("text").alias("text"))


def plausible(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [x.to_pylist() for x in batch.columns[4:6]]
            differ = np.zeros(batch.num_rows, np.int64)
            size = [min(len(x), len(y)) for x, y in zip(*bits, strict=True)]
            for m in set(size):
                at = [i for i, v in enumerate(size) if v == m]
                x, y = (folded([b[i] for i in at], m) for b in bits)
                differ[at] = np.bitwise_count(x ^ y).sum(1)
            keep = pa.array(may_be_similar(differ, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    one, two = (held.select(F.col("class").alias(f"_{x}"), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    joined = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
    return joined.mapInArrow(run, "a long, b long")


def first_rows(t: pa.RecordBatch) -> np.ndarray:
    """The first row of each row's cell (sig, lo, hi)."""
    keys = [t.column(c).to_numpy() for c in ("sig", "lo", "hi")]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], 0))
    return np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by cell, in batches that split none."""
    rest: list[pa.RecordBatch] = []  # rows of the cell that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest:
            old = tuple(rest[0].column(c)[0].as_py() for c in ("sig", "lo", "hi"))
            if old == tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("sig", "lo", "hi")):
                rest.append(batch)
                continue
        t = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
        last = int(first_rows(t)[-1])
        if last:
            yield t.slice(0, last)
        rest = [t.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def in_cells(mixed: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """The members of groups (sig, class, root, n members) dealt to cells of bounded size: any two blocks of a group meet in one.

    ``least`` are the class's least signatures of open groups, in their order.
    """
    sigs = mixed.groupBy(F.col("class").alias("c")).agg(F.slice(F.array_sort(F.collect_list("sig")), 1, OWNERS).alias("least"))
    known = held.select(F.col("class").alias("k"), "size", "bits")
    rows = mixed.join(sigs.join(known, F.col("c") == F.col("k")), F.col("class") == F.col("c")).select("sig", "class", "root", "n", "size", "bits", "least")
    top = mixed.join(known.select("k", "size"), F.col("class") == F.col("k")).groupBy(F.col("sig").alias("s")).agg(F.max("size").alias("top"))
    members = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.col("top"))))
    blocks = F.ceil(F.col("n") / members).cast("int")
    dealt = rows.join(top, F.col("sig") == F.col("s")).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return other.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "class", "root", "size", "bits", "own", "least")


def pairs_within(cells: DataFrame, percent: int, members: bool) -> DataFrame:
    """What sketches don't rule out of each cell's pairs with different roots, each pair in the cell of its least common signature.

    ``members``: the rows (sig, lo, hi, class, root) that have such a pair, which are no more than the cell's; else the pairs (a, b).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def owned(sig: int, i: np.ndarray, j: np.ndarray, least: list) -> np.ndarray:
            """Whether no signature below ``sig`` is in the lists of both; lists that were cut may let a pair through twice."""
            out = np.ones(len(i), bool)
            for x in np.unique(i):
                at = np.flatnonzero(i == x)
                mine = least[x][least[x] < sig]
                if len(mine):
                    rows = [least[y] for y in j[at]]
                    hit = np.isin(np.concatenate(rows), mine)
                    out[at] = ~np.logical_or.reduceat(hit, np.cumsum([0, *map(len, rows[:-1])]))
            return out

        for t in whole_cells(batches):
            start = first_rows(t)
            sig, ids, roots, sizes, own = (t.column(c).to_numpy() for c in ("sig", "class", "root", "size", "own"))
            same, bits, least = t.column("lo").to_numpy() == t.column("hi").to_numpy(), t.column("bits").to_pylist(), t.column("least")
            width = np.array([len(x) for x in bits])
            words = {m: folded([x if len(x) >= m else bytes(m) for x in bits], m) for m in set(width.tolist())}
            before = np.arange(len(start)) - start  # rows of the cell that stand before the row
            wanted = np.zeros(len(start), bool)
            for rows in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(before) // PAIRS)) + 1):
                i = np.repeat(rows, before[rows])
                j = start[i] + np.arange(len(i)) - np.repeat(np.cumsum(before[rows]) - before[rows], before[rows])
                ok = (roots[i] != roots[j]) & (same[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                m, differ = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
                for w, held_words in words.items():
                    at = np.flatnonzero(m == w)
                    differ[at] = np.bitwise_count(held_words[i[at]] ^ held_words[j[at]]).sum(1)
                ok = may_be_similar(differ, sizes[i], sizes[j], percent)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                lists = {x: least[x].values.to_numpy() for x in np.unique(np.append(i, j)).tolist()}
                ok = np.concatenate([owned(sig[i[part[0]]], i[part], j[part], lists) for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(start[i])) + 1)])
                i, j = i[ok], j[ok]
                if members:
                    wanted[i] = wanted[j] = True
                elif len(i):
                    both = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])
            if members and wanted.any():
                yield t.select(["sig", "lo", "hi", "class", "root"]).filter(pa.array(wanted))

    rows = cells.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return rows.mapInArrow(run, "sig long, lo int, hi int, class long, root long" if members else "a long, b long")


def forests(members: DataFrame, held_texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that join the members of each cell (sig, lo, hi, class, root) as far as similar sets do; fewer than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of

        def links(cell: pa.RecordBatch) -> Iterator[tuple[int, int]]:
            ids, roots = cell.column("class").to_pylist(), cell.column("root").to_pylist()
            sets = [of(x) for x in cell.column("text").to_pylist()]
            bits, size, up = [sketch(s) for s in sets], np.array([len(s) for s in sets]), {r: r for r in roots}

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for m in sorted({len(x) for x in bits}):
                rows = [i for i, x in enumerate(bits) if len(x) >= m]
                table = folded([bits[i] for i in rows], m)
                for at, i in enumerate(rows):
                    # Pairs of which the shorter sketch has m bytes.
                    near = may_be_similar(np.bitwise_count(table[:at] ^ table[at]).sum(1, dtype=np.int64), size[rows[:at]], size[i], percent)
                    for k in np.flatnonzero(near).tolist():
                        j = rows[k]
                        if min(len(bits[i]), len(bits[j])) == m and root(roots[i]) != root(roots[j]) and similar(sets[i], sets[j], percent):
                            up[root(roots[i])] = root(roots[j])
                            yield min(ids[i], ids[j]), max(ids[i], ids[j])

        for t in whole_cells(batches):
            cuts = [*np.unique(first_rows(t)).tolist(), t.num_rows]
            found = [x for a, b in itertools.pairwise(cuts) for x in links(t.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = members.join(held_texts.select(F.col("class").alias("c"), "text"), F.col("class") == F.col("c")).drop("c")
    return rows.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, held_texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = functools.lru_cache(maxsize=256)(Shingles(words).of)
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ok += [similar(of(x), of(y), percent) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one, two = (held_texts.select(F.col("class").alias(f"_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    joined = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


class _Join:
    """The tables that all rounds share."""

    def __init__(self, df: DataFrame, work: Workspace, key: str, text: str, words: int, percent: int, block: int):
        self.work, self.words, self.percent, self.block = work, words, percent, block
        rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        self.rows = rows.withColumn("h", F.xxhash64("text"))
        self.own = work.write(classes_of(self.rows, words), "classes")
        self.found = work.write(groups(signed(rows, words, percent)), "groups")
        known = self.own.filter("class is not null")
        first = known.groupBy("class").agg(F.min(F.struct("key", "h")).alias("rep"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
        self.held = work.write(self.found.select("class").distinct().join(first, "class"), "held")

    def texts(self, classes: DataFrame, name: str) -> DataFrame:
        return self.work.write(texts_of(self.rows, self.held.join(classes.distinct(), "class").select("class", "rep")), f"texts-{name}")

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """The links among ``pairs``: sketches first, then texts."""
        left = self.work.write(plausible(pairs, self.held, self.percent), f"pairs-{name}")
        held_texts = self.texts(left.select(F.explode(F.array("a", "b")).alias("class")), name)
        out = self.work.write(verified(left, held_texts, self.words, self.percent), f"links-{name}")
        self.dropped(f"pairs-{name}", f"texts-{name}")
        return out

    def joined_cells(self, open_groups: DataFrame) -> DataFrame:
        """Links that join what is similar in open groups."""
        members = self.work.write(pairs_within(in_cells(open_groups, self.held, self.block), self.percent, True), "members")
        out = self.work.write(forests(members, self.texts(members.select("class"), "cells"), self.words, self.percent), "links-cells")
        self.dropped("members", "texts-cells")
        return out

    def dropped(self, *names: str) -> None:
        for name in names:
            self.work.drop(name)


def _joined(roots: DataFrame, links: DataFrame, work: Workspace, i: int) -> DataFrame:
    """``roots`` (node, root) with further links: only the roots that links join, and nodes without one, form the new graph."""
    a, b = (roots.select(F.col("node").alias(f"node_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    ends = links.join(a, F.col("a") == F.col("node_a"), "left").join(b, F.col("b") == F.col("node_b"), "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = components(ends, work, f"roots-{i}").select(F.col("node").alias("k"), F.col("root").alias("to"))
    kept = roots.join(moved, F.col("root") == F.col("k"), "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots, F.col("k") == F.col("node"), "left_anti").select(F.col("k").alias("node"), F.col("to").alias("root"))
    return work.write(kept.unionByName(fresh), f"roots-{i}-all")


def links(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links: the pairs (a, b; a < b) of similar classes, and key, n_shingles, class and n_links of every row.

    Rows of one class are linked with each other, and with all rows of the classes that pairs name; ``n_links``
    counts the other rows that a row is linked with.  A null class has none.  No pair is left out because others
    connect its ends, so the table grows with the number of links; :func:`link` is the form for components alone.
    """
    j = _Join(df, work, key, text, words, percent, block)
    sized = j.own.filter("class is not null").groupBy("class").agg(F.count("*").alias("n_rows"))
    size = j.found.groupBy(F.col("sig").alias("s")).agg(F.count("*").alias("n"))
    # Every class stands for itself as its root, so no pair counts as connected.
    apart = j.found.join(size, F.col("sig") == F.col("s")).select("sig", "class", F.col("class").alias("root"), "n")
    left = work.write(pairs_within(in_cells(apart, j.held, block), percent, False).distinct(), "link-pairs")
    pairs = work.write(verified(left, j.texts(left.select(F.explode(F.array("a", "b")).alias("class")), "links"), words, percent), "links")
    j.dropped("groups", "held", "link-pairs", "texts-links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sized.select(F.col("class").alias("b"), "n_rows"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n_rows").alias("others"))
    count = sized.join(others, F.col("class") == F.col("c"), "left").select(F.col("class").alias("k"), (F.col("n_rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    counted = j.own.join(count, F.col("class") == F.col("k"), "left").select(F.col("key").alias(key), "n_shingles", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return pairs, counted


def link(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) of every row."""
    j = _Join(df, work, key, text, words, percent, block)
    links_ = j.compared(_ordered(j.found, "class", "first"), "0")
    roots, open_groups, new = components(links_, work, "roots-0"), j.found, True
    for i in range(1, STARS + 1):
        if new:
            # Groups that links don't connect as a whole: their members with their components.  A group of two has been compared.
            rooted = open_groups.select("sig", "class").join(roots, F.col("class") == F.col("node"), "left").select("sig", "class", F.coalesce("root", "class").alias("root"))
            split = rooted.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).filter("x < y and n > 2").select(F.col("sig").alias("s"), "n")
            open_groups = work.write(rooted.join(split, F.col("sig") == F.col("s")).drop("s"), f"open-{i}")
            if open_groups.isEmpty():
                break
        if i == STARS:
            found = j.joined_cells(open_groups)
        else:  # the member with most links
            degree = links_.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
            rank = open_groups.join(degree, F.col("class") == F.col("node"), "left").select("sig", "class", "root", F.coalesce("count", F.lit(0)).alias("rank"))
            heads = rank.groupBy(F.col("sig").alias("s")).agg(F.max(F.struct("rank", "class", "root")).alias("head"))
            pairs = _ordered(open_groups.join(heads, F.col("sig") == F.col("s")).filter("root != head.root").select("class", F.col("head.class").alias("head")), "class", "head")
            found = j.compared(pairs, f"{i}")
        new = not found.isEmpty()
        if new:
            roots = _joined(roots, found, work, i)

    firsts = j.own.filter("class is not null").groupBy("class").agg(F.min("key").alias("key"))
    labels = firsts.join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "key")
    least = labels.groupBy("root").agg(F.min("key").alias("component_id"))
    component = work.write(labels.select("class", "root").join(least, "root").select(F.col("class").alias("c"), "component_id"), "components")
    j.dropped("groups", "held", *[f"open-{i}" for i in range(1, STARS + 1)])
    linked = j.own.filter("class is not null").join(component, F.col("class") == F.col("c")).select("key", "n_shingles", "component_id")
    alone = j.own.filter("class is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("key", key)
