"""Token ids in a compact binary table, in the order of the documents' keys.

A written row is a block of whole documents: their keys and token counts, the
ids that occur in the order of their frequency in the block (``ranks``), and the
ranks of all ids in a byte-aligned variable-length code whose lengths stand in
separate control bytes (``controls``: two bits for each value, four values a
byte; ``data``: one to four bytes for each value, low byte first).  Readers look
the lengths up in a table of the 256 control bytes, without a loop over values.

The documents are range-partitioned by key before they are tokenized; a shard is
one partition.  Only counts for each shard meet in one place.

Defined cases: a null or empty text is its end id alone; null keys come first;
rows that share a key are ordered by their text; an empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import SLICE_ROWS, Workspace, texts
from tidewell.llm.tokens import tokenizer

END_ID, BLOCK_IDS = 2, 1 << 21

#: Bytes of each of the four values of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(controls, data) of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    a, b, c, d = codes.reshape(-1, 4).T
    most = int(size.max(initial=1))
    data = values.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most, dtype=np.uint8) < size[:, None]]
    return (a | b << 2 | c << 4 | d << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_values(controls: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(controls, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + bytes(3), np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids that occur, most frequent first; the rank of each id)."""
    count = np.bincount(ids)
    ranks = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    rank = np.zeros(len(count), np.uint32)
    rank[ranks] = np.arange(len(ranks))
    return ranks.astype("<u4"), rank[ids]


def token_blocks(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of all documents, ready to be written."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, start = tokenizer(vocabulary).encode, TaskContext.get().partitionId(), 0
        names = ["shard", "start", "n_ids", "keys", "counts", "ranks", "controls", "data"]

        def block() -> pa.RecordBatch:
            nonlocal start
            ids = np.frombuffer(b"".join(docs), "<u4")
            ranks, values = by_frequency(ids)
            row = [shard, start, len(ids), keys, [len(x) // 4 for x in docs], ranks.tobytes(), *encode_values(values)]
            start += len(ids)
            kinds = [pa.int64()] * 3 + [pa.list_(kind), pa.list_(pa.int64())] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        keys, docs, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for k, ids in zip(part.column(0).to_pylist(), encode(texts(part.column(1))), strict=True):
                    keys.append(k)
                    docs.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= block_ids:
                        yield block()
                        keys, docs, held = [], [], 0
        if keys:
            yield block()

    kind = df.schema[key].dataType.simpleString()
    ordered = df.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    return ordered.mapInArrow(run, f"shard long, start long, n_ids long, `keys` array<{kind}>, counts array<long>, ranks binary, controls binary, data binary")


def read_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids (little-endian unsigned 32-bit) of each document of written blocks."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, start, n, keys, counts, ranks, controls, data = (c[0].as_py() for c in row.columns)
                ids = np.frombuffer(ranks, "<u4")[decode_values(controls, data, n)].tobytes()
                ends = np.cumsum(counts)
                starts = (ends - counts).tolist()
                for at in range(0, len(keys), SLICE_ROWS):
                    some = slice(at, at + SLICE_ROWS)
                    cut = [ids[4 * a : 4 * (a + m)] for a, m in zip(starts[some], counts[some], strict=True)]
                    columns = [pa.array(keys[some], row.column(3).type.value_type), pa.array([shard] * len(cut), pa.int64()), pa.array([start + a for a in starts[some]], pa.int64()), pa.array(counts[some], pa.int64()), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "shard", "start", "n_tokens", "ids"])

    read = blocks.select("shard", "start", "n_ids", "keys", "counts", "ranks", "controls", "data").mapInArrow(run, f"`{key}` {kind}, shard long, start long, n_tokens long, ids binary")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each shard, that is for each task of the writer
    before = totals.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return read.join(F.broadcast(before), F.col("shard") == F.col("s")).select(key, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def write_documents(df: DataFrame, work: Workspace, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the blocks in the shared folder and return the table that was written."""
    return work.write(token_blocks(df, vocabulary, key, text, end_id), "blocks")
