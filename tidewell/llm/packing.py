"""Cost-balanced packing of documents into training sequences.

A document is the ids of its text and an end id.  A sequence's cost is the sum
over its pieces of ``linear * n + quadratic * n * n``, the work of a model whose
attention stays within a document.  Pieces go in descending length to the
lowest-cost sequence that still has room for them; one that fits nowhere is cut.

Packing is local to blocks of about ``block_tokens`` tokens of one partition, so
there is no shuffle and a task's memory is bounded.  Each block has just as much
room as tokens: sequences of ``length`` and, for the rest, one sequence for each
power of two in it, so no sequence needs padding.

Defined cases: a null or empty text is its end id alone; an id of a document may
be null; repeated rows are packed each for itself; equal lengths keep the order
of the input; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewell.llm.common import SLICE_ROWS, texts
from tidewell.llm.tokens import tokenizer

LENGTH, END_ID, BLOCK_TOKENS = 2048, 1, 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def rooms(total: int, length: int) -> list[int]:
    """The sizes of the sequences that hold ``total`` tokens without padding."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    out, rests, made = [], [], 0
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            out.append((d, start, length, made, 0))
            made += 1
        if n % length:
            rests.append((n % length, d, n - n % length))
    caps = np.array(rooms(sum(n for n, _, _ in rests), length), np.int64)
    room, cost = caps.copy(), np.zeros(len(caps))
    for n, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room == room.max())
            b = int(fits[np.argmin(cost[fits])])
            take = min(n, int(room[b]))
            out.append((d, start, take, made + b, int(caps[b] - room[b])))
            room[b] -= take
            cost[b] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out


def pack_documents(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = tokenizer(vocabulary).encode, TaskContext.get().partitionId() << 40
        names = [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def packed(keys: list, docs: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            sizes = [len(x) // 4 for x in docs]
            pieces = pack(sizes, length, linear, quadratic)
            for at in range(0, len(pieces), 4096):
                some = pieces[at : at + 4096]
                d, start, n, seq, offset = (list(c) for c in zip(*some, strict=True))
                columns = [pa.array([keys[i] for i in d], kind), *(pa.array(c, pa.int64()) for c in (start, n, [sizes[i] for i in d], [first + s for s in seq], offset)), pa.array([docs[i][4 * s : 4 * (s + m)] for i, s, m in zip(d, start, n, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
            first += 1 + max(p[3] for p in pieces)

        keys, docs, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for k, ids in zip(part.column(0).to_pylist(), encode(texts(part.column(1))), strict=True):
                    keys.append(k)
                    docs.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield from packed(keys, docs)
                        keys, docs, held = [], [], 0
        if keys:
            yield from packed(keys, docs)

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
