"""Collocations: phrases of 2 to 4 words that occur often and whose parts seldom occur apart.

1. Every n-gram (of 1 to 4 words) falls into a cell of a sketch by its hash (with its language).  Tasks count
   cells in chunks, slabs of cells are summed, and a cell's sum bounds the counts of the n-grams in it
   from above.  Only the cells that reach the least count go on, in a filter that lets a few others through.
2. Parts of the text, of ``HELD`` bytes at most, find their candidates: n-grams whose cell is in the filter and whose
   parts' cells are.  No phrase that is frequent enough is missed; some that aren't come along.
3. A part's candidates compile into pyahocorasick automata.  Every word of one
   is a code of a few characters there, and all else (ends of pieces, other words) is the delimiter, which no pattern holds: a match
   neither begins within a word nor runs across a guard.  The part is scanned and all matches count, overlapping ones
   too, by language.
4. Counts are summed by Spark, and only then thresholds, scores and ranks apply.

So the text is scanned twice whatever its size and however many candidates it has.  The sketch has about a cell for every four
bytes of text, up to ``2 ** CELL_BITS``.  Within a part n-grams are told apart by 64-bit hashes: among n of them n * n / 2**65
pairs are expected to be taken for one.

Defined cases: a null or empty text has no words; a null language is ``und``; rows that repeat count as often as
they stand there; texts of any length count whole; a piece is never cut.  Equal scores go by count, then by phrase
in the order of its UTF-8 bytes.  An empty table gives an empty table.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SLICE_ROWS, Workspace, texts
from tidewell.llm.jaccard import ODD, all_hashes, mix

LEAST, COVER, TOP, LONGEST = 30, 80, 2000, 4
#: The greatest sketch; the cells of a slab, at least and at most; bits of the filter for each cell that reaches the least count.
CELL_BITS, SLAB_BITS, MOST_SLAB_BITS, FILTER_BITS = 36, 16, 20, 16
#: n-grams that a task counts at a time; bytes of text that it looks at together; candidates and bytes of text of a part; languages of a part.
CHUNK, BLOB, SEEN, HELD, LANGUAGES = 1 << 22, 1 << 20, 1 << 19, 32 << 20, 256
#: Places for hashes of n-grams that a part has seen.
LAST = 1 << 21
#: Candidates of a block, and bytes of their words.
BLOCK_PHRASES, BLOCK_BYTES = 1_200_000, 48 << 20
#: Cells that reach the least count, for each bucket of candidates.
BUCKET = 1 << 14

#: Ends of pieces become line breaks, tabs spaces, A-Z a-z.
TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Digits of words' codes, and the first of their characters.
DIGITS, FIRST = 64, 0x100


def blobs(column: list[str]) -> Iterator[bytes]:
    """The texts' pieces, one a line, in parts of about ``BLOB`` bytes; long texts are cut between pieces."""
    held, size = [], 0
    for t in column:
        data = t.encode().translate(TABLE)
        while len(data) > BLOB:
            cut = data.rfind(b"\n", 0, BLOB) + 1 or data.find(b"\n") + 1 or len(data)
            yield data[:cut]
            data = data[cut:]
        held.append(data)
        size += len(data)
        if size >= BLOB:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, blob) of batches of (language, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part, groups = batch.slice(at, SLICE_ROWS), {}
            for lang, t in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                groups.setdefault(lang, []).append(t)
            for lang, column in groups.items():
                yield from ((lang, data) for data in blobs(column))


def grams(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(where each n-gram begins, by word; its 64-bit hash) for 1 to ``LONGEST`` words; none crosses a line break."""
    b = np.frombuffer(data, np.uint8)
    letter = (b != 32) & (b != 10)
    piece = np.cumsum(b == 10, dtype=np.int32)[np.flatnonzero(letter & ~np.append(False, letter[:-1]))]
    h = all_hashes(data)
    out = [(np.arange(len(h)), h)]
    state = h * ODD[0]
    for k in range(1, LONGEST):
        n = max(0, len(h) - k)
        state = state[:n] + h[k:] * ODD[k] if n else state[:0]
        state ^= state >> np.uint64(31)
        at = np.flatnonzero(piece[k:] == piece[:n])
        out.append((at, mix(state[at])))
    return out


def _salt(lang: str) -> np.uint64:
    return mix(all_hashes(b"x" + lang.encode().hex().encode())[:1] + ODD[4])[0]


class _Sketch:
    """Cells of n-grams' hashes, and a filter that holds those that reach the least count; a few others get through it.

    There are as many cells as the text needs, since tasks sum them in slabs; only the filter is broadcast.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.room(0)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def _places(self, cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(byte, bit) of the first or second place of each cell in the filter."""
        at = (cells * ODD[0]) >> np.uint64(64 - self.size) if k else cells & np.uint64((1 << self.size) - 1)
        return at >> np.uint64(3), (at & np.uint64(7)).astype(np.uint8)

    def room(self, n: int) -> None:
        """For ``n`` cells; where all cells have a bit of their own, the filter is exact."""
        self.n, self.size = n, min(self.bits, max(3, (FILTER_BITS * n).bit_length()))
        self.held = np.zeros(1 << self.size - 3, np.uint8)

    def add(self, cells: np.ndarray) -> None:
        for k in range(1 if self.size == self.bits else 2):
            at, bit = self._places(cells.astype(np.uint64), k)
            np.bitwise_or.at(self.held, at, np.uint8(1) << bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cells, left = self.cells(hashes), np.arange(len(hashes))
        for k in range(1 if self.size == self.bits else 2):
            at, bit = self._places(cells[left], k)
            left = left[(self.held[at] >> bit & 1).astype(bool)]
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out


def heavy_cells(rows: DataFrame, work: Workspace, bits: int, least: int) -> _Sketch:
    """The sketch of ``2 ** bits`` cells with those that reach the least count, by one scan."""
    sketch, low = _Sketch(bits), min(max(SLAB_BITS, bits - 12), MOST_SLAB_BITS)
    kind = "<u2" if low <= 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            slab = cells >> np.uint64(low)
            start = np.flatnonzero(np.append(True, slab[1:] != slab[:-1]))
            cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(cells)], strict=True))
            places, n = (cells & np.uint64((1 << low) - 1)).astype(kind), n.astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array(slab[start].astype(np.int32)), pa.array([places[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())], ["slab", "cells", "counts"])

        for lang, data in by_language(batches):
            salt = _salt(lang)
            for _, h in grams(data):
                held.append(sketch.cells(mix(h ^ salt)))
                size += len(held[-1])
            if size >= CHUNK:
                yield chunk()
                held, size = [], 0
        if size:
            yield chunk()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, n = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([np.flatnonzero(n >= least).astype("<u4").tobytes()], pa.binary())], ["slab", "cells"])

        for batch in batches:
            for s, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != slab:
                    if slab is not None:
                        yield row()
                    slab, n = s, np.zeros(1 << low, np.int64)
                n[np.frombuffer(cells, kind)] += np.frombuffer(counts, "<u4")
        if slab is not None:
            yield row()

    summed = rows.mapInArrow(count, "slab int, cells binary, counts binary").repartition("slab").sortWithinPartitions("slab").mapInArrow(total, "slab int, cells binary")
    found = work.write(summed, "heavy")
    n = found.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0] // 4
    sketch.room(n)
    for r in found.toLocalIterator():  # a few bytes for each cell that reaches the count
        sketch.add((r["slab"] << low) + np.frombuffer(r["cells"], "<u4").astype(np.int64))
    return sketch


def counts(rows: DataFrame, sketch: _Sketch, least: int, block_phrases: int, block_bytes: int) -> DataFrame:
    """(lang, phrase, f) of the n-grams that occur ``least`` times and more; a null phrase: all words of the language.

    Each part of the texts compiles its own candidates only and is scanned once, so work grows with the text and not with how many
    candidates there are in all.  Parts give lines of phrases by buckets of their hashes, and a bucket's counts are summed.
    """
    held = rows.sparkSession.sparkContext.broadcast(sketch.held)
    bits, size = sketch.bits, sketch.size
    buckets = max(64, sketch.n // BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Sketch(bits)
        known.size, known.held = size, held.value
        parts: dict[str, _Part] = {}
        last = np.arange(LAST, dtype=np.uint64) ^ np.uint64(1)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, part in parts.items():
                yield part.given(lang, buckets, block_phrases, block_bytes)
            parts.clear()
            last[:] = np.arange(LAST, dtype=np.uint64) ^ np.uint64(1)  # each stands at a place that isn't its own

        for lang, data in by_language(batches):
            if lang not in parts:
                if len(parts) >= LANGUAGES:
                    yield from given()
                parts[lang] = _Part(_salt(lang))
            parts[lang].add(data, known, last)
            if sum(len(p.seen) for p in parts.values()) >= SEEN or sum(p.bytes for p in parts.values()) >= HELD:
                yield from given()
        yield from given()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, {}

        def row() -> pa.RecordBatch:
            out = [(lang, p, f) for lang, found in sums.items() for p, f in found.items() if f >= least or not p]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1].decode() or None for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for bucket, lang, lines, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if at is not None:
                        yield row()
                    at, sums = bucket, {}
                found = sums.setdefault(lang, {})
                for p, f in zip(lines.split(b"\n"), np.frombuffer(n, "<u4").tolist(), strict=True):
                    found[p] = found.get(p, 0) + f
        if at is not None:
            yield row()

    return rows.mapInArrow(run, "bucket int, lang string, lines binary, counts binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "lang string, phrase string, f long")


class _Part:
    """Texts of one language that a task holds, and their candidates: n-grams that the filter lets through, with all their parts."""

    def __init__(self, salt: np.uint64):
        self.salt, self.texts, self.bytes, self.words = salt, [], 0, 0
        self.seen: dict[int, str] = {}

    def add(self, data: bytes, known: _Sketch, last: np.ndarray) -> None:
        """``last`` has the hash that came last at each place; most n-grams are known by it."""
        words, below, seen, mask = data.split(), None, self.seen, np.uint64(len(last) - 1)
        self.texts.append(data)
        self.bytes += len(data)
        self.words += len(words)
        for k, (at, h) in enumerate(grams(data), 1):
            if below is not None:
                both = below[at] & below[at + 1]
                at, h = at[both], h[both]
            h = mix(h ^ self.salt)
            ok = known.has(h)
            at, h = at[ok], h[ok]
            below = np.zeros(len(words) + 1, bool)
            below[at] = True
            new = last[h & mask] != h
            h, first = np.unique(h[new], return_index=True)
            last[h & mask] = h
            for x, i in zip(h.tolist(), at[new][first].tolist(), strict=True):
                if x not in seen:
                    seen[x] = b" ".join(words[i : i + k]).decode()

    def given(self, lang: str, buckets: int, block_phrases: int, block_bytes: int) -> pa.RecordBatch:
        """(bucket, lang, lines, counts); bucket -1 has the words."""
        phrases, bucket = list(self.seen.values()), np.fromiter(self.seen, np.uint64, len(self.seen)) % np.uint64(buckets)
        size = np.cumsum([len(p) for p in phrases])
        f, at = np.zeros(len(phrases), np.int64), 0
        while at < len(phrases):
            # Of more candidates than an automaton takes, each block scans the part.
            end = max(at + 1, min(at + block_phrases, int(np.searchsorted(size, (size[at - 1] if at else 0) + block_bytes, "right"))))
            scanner = _Scanner(phrases[at:end])
            for data in self.texts:
                f[at:end] += scanner.count(data)
            at = end
        out = [(-1, lang, b"", np.array([self.words], "<u4").tobytes())]
        order = np.argsort(bucket, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
            out.append((int(bucket[some[0]]), lang, "\n".join([phrases[i] for i in some.tolist()]).encode(), f[some].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["bucket", "lang", "lines", "counts"])


def symbols(n: int) -> np.ndarray:
    """The code of each of ``n`` words as a row of characters, the guard's first.

    Nodes of an automaton look through their children one by one, so an alphabet of words would be slow: a word is a
    fixed number of digits.  First digits have characters of their own, so no match begins within a word.
    """
    digits = 1
    while DIGITS**digits <= n:
        digits += 1
    code = np.arange(n + 1)[:, None] // DIGITS ** np.arange(digits)[::-1] % DIGITS + FIRST
    code[:, 0] += DIGITS
    code[0] = 0
    return code.astype("<u4")


class _Scanner:
    """The automaton of a block of phrases."""

    def __init__(self, phrases: list[str]):
        words = sorted({w for p in phrases for w in p.split(" ")})
        self.number = {w.encode(): i for i, w in enumerate(words, 1)}
        self.code = symbols(len(words))
        digits, codes = self.code.shape[1], self.code[1:].tobytes().decode("utf-32-le")
        code = {w: codes[i * digits : (i + 1) * digits] for i, w in enumerate(words)}.__getitem__
        self.automaton = ahocorasick.Automaton()
        self.single = np.full(len(words) + 1, -1, np.int64)
        for i, p in enumerate(phrases):
            ids = p.split(" ")
            if len(ids) == 1:
                self.single[self.number[p.encode()]] = i
            else:
                self.automaton.add_word("".join(map(code, ids)), i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.n = len(phrases)

    def count(self, data: bytes) -> np.ndarray:
        """How often each phrase occurs in the lines."""
        get = self.number.get
        # No word holds a point; it stands for the end of a piece.
        ids = np.array([get(w, 0) for w in data.replace(b"\n", b" . ").split()], np.int64)
        out = np.zeros(self.n, np.int64)
        if len(self.automaton) and len(ids):
            found = np.fromiter((i for _, i in self.automaton.iter(self.code[ids].tobytes().decode("utf-32-le"))), np.int64)
            out += np.bincount(found, minlength=self.n)
        one = np.bincount(ids, minlength=len(self.single))
        some = np.flatnonzero((self.single >= 0) & (one > 0))
        out[self.single[some]] = one[some]
        return out


def counted(df: DataFrame, work: Workspace, lang: str, text: str, least: int, cell_bits: int, block_phrases: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of frequent phrases and words, (lang, n))."""
    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = heavy_cells(rows, work, max(SLAB_BITS, min(cell_bits, (size // 4).bit_length())), least)
    sums = work.write(counts(rows, sketch, least, block_phrases, block_bytes), "counts")
    return sums.filter("phrase is not null"), sums.filter("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(df: DataFrame, work: Workspace, lang: str = "lang", text: str = "text", least: int = LEAST, cover: int = COVER, top: int = TOP, cell_bits: int = CELL_BITS, block_phrases: int = BLOCK_PHRASES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of each language's ``top`` phrases.

    a: occurrences of the phrase, at least ``least``; cut after its first words, l and r are those of the parts, and
    the score is floor(2000000 * a / (l + r)), of the lowest-scoring cut (the first of equals).  Phrases that stand within a
    longer candidate with 100 * its occurrences >= cover * a are left out.  n: all words of the language.
    """
    f, total = counted(df, work, lang, text, least, cell_bits, block_phrases, block_bytes)
    words = F.split("phrase", " ")
    found = f.withColumn("w", words).filter((F.size("w") > 1) & (F.col("f") >= least)).select("lang", "phrase", F.col("f").alias("a"), "w")

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.size("w") - F.col("k")))
    left, right = (f.select(F.col("lang").alias(f"lang_{x}"), F.col("phrase").alias(f"phrase_{x}"), F.col("f").alias(x)) for x in "lr")
    cuts = cuts.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("first") == F.col("phrase_l"))).join(right, (F.col("lang") == F.col("lang_r")) & (F.col("rest") == F.col("phrase_r")))
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(25,0)) * 2000000) div (cast(l as decimal(25,0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    # Each longer candidate's parts of 2 words and more.
    inner = found.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", "a", part(F.col("at"), F.col("m")).alias("part")).groupBy(F.col("lang").alias("lang_i"), "part").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, (F.col("lang") == F.col("lang_i")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(25,0)") * 100 < F.col("a").cast("decimal(25,0)") * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ranked.join(F.broadcast(total.select(F.col("lang").alias("lang_n"), "n")), F.col("lang") == F.col("lang_n"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
