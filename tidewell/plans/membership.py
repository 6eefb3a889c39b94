"""Which rows the import log knows, without reading all of it.

Every append to the log is a part of its own and has a Bloom filter of its rows' (row_hash, target): tasks set bits,
slices of the bits are joined by OR.  A lookup reads filters, finds the parts that may
hold one of the rows, and only those parts are read; an exact join decides.  Filters never
miss a row, so nothing depends on their errors but the number of parts that are read.

Defined cases: a null hash is a value like others in a filter, and equal to none in a join; an empty log knows
nothing; a part without a filter is always read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans import state

#: Bits for each row, hashes of a row, the least and greatest filter (powers of two), bytes of a slice.
PER_ROW, HASHES, LEAST_BITS, MOST_BITS, SLICE = 12, 8, 1 << 10, 1 << 26, 1 << 13
#: Bytes of filters that are looked at together.
GROUP_BYTES = 64 << 20
FILTERS = "part string, size long, at int, bits binary"


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """One row of ``HASHES`` bit numbers for each 64-bit hash."""
    x = hashes.view(np.uint64)
    step = x >> np.uint64(32) | np.uint64(1)
    return (x[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(size - 1)


def filter_of(rows: DataFrame, n: int, part: str) -> DataFrame:
    """The filter (part, size, at, bits) of ``n`` rows (row_hash, target): one row for each slice that has a bit."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_ROW * n - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[positions(batch.column(0).to_numpy(), size).ravel()] = True
        packed = np.packbits(bits, bitorder="little")
        some = [i for i in range(0, len(packed), SLICE) if packed[i : i + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in some], pa.int32()), pa.array([packed[i : i + SLICE].tobytes() for i in some], pa.binary())], ["at", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([size]), pa.array([held[0]], pa.int32()), pa.array([held[1].tobytes()], pa.binary())], ["part", "size", "at", "bits"])

        for batch in batches:
            for at, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(bits, np.uint8)
                if held is not None and held[0] != at:
                    yield row()
                    held = None
                held = (at, now | held[1]) if held else (at, now)
        if held is not None:
            yield row()

    marked = rows.select(F.xxhash64("row_hash", "target").alias("h")).mapInArrow(mark, "at int, bits binary")
    return marked.repartition("at").sortWithinPartitions("at").mapInArrow(join, FILTERS)


def parts_with(rows: DataFrame, filters: dict[str, tuple[int, np.ndarray]]) -> set[str]:
    """The parts whose filter may hold one of ``rows`` (row_hash, target)."""
    held, names = rows.sparkSession.sparkContext.broadcast(filters), sorted(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = dict(held.value)
        for batch in batches:
            x, hit = batch.column(0).to_numpy(), []
            for part, (size, bits) in open_.items():
                at = positions(x, size).astype(np.int64)
                if (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1).any():
                    hit.append(part)
            for part in hit:
                del open_[part]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], ["part"])

    found = rows.select(F.xxhash64("row_hash", "target").alias("h")).mapInArrow(run, "part string").distinct().collect() if names else []
    return {r["part"] for r in found}


def may_hold(store: state.Store, rows: DataFrame, log: str = "import_log") -> set[str]:
    """The keys of the log's parts that may hold one of ``rows`` (row_hash, target)."""
    known = store.read(f"{log}_filters", FILTERS)
    sizes = {r["part"]: r["size"] for r in known.select("part", "size").distinct().collect()}  # a row a part
    out, group, held = {k for k in store.parts(log) if k not in sizes}, [], 0
    groups = [group]
    for part in sorted(set(store.parts(log)) & set(sizes)):
        if held + sizes[part] // 8 > GROUP_BYTES and group:
            group, held = [], 0
            groups.append(group)
        group.append(part)
        held += sizes[part] // 8
    for names in groups:
        filters = {p: (sizes[p], np.zeros(sizes[p] // 8, np.uint8)) for p in names}
        for r in known.filter(F.col("part").isin(names)).toLocalIterator() if names else ():  # GROUP_BYTES at most
            bits = np.frombuffer(r["bits"], np.uint8)
            filters[r["part"]][1][r["at"] * SLICE : r["at"] * SLICE + len(bits)] = bits
        out |= parts_with(rows, filters)
    return out


def read_log(store: state.Store, rows: DataFrame, log: str = "import_log") -> DataFrame:
    """The parts of the log that may hold one of ``rows`` (row_hash, target)."""
    return store.read(log, state.IMPORT_LOG, may_hold(store, rows, log).__contains__)


def append_log(store: state.Store, entries: DataFrame, log: str = "import_log") -> None:
    """A new part of the log, and its filter; a part whose filter got lost is merely read each time."""
    (part,) = store.append(log, entries)
    written = store.read(log, parts=part.__eq__)
    if n := written.count():
        store.append(f"{log}_filters", filter_of(written, n, part))
