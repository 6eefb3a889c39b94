"""Ranked lexical search over an index of document shards with integer impacts.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z
lower-cased.  :func:`write_index` makes two passes: one counts documents and terms
of the whole corpus, the other writes shards.  A row of the index is a shard of whole
documents: its sorted terms, and for each term the documents that hold it and
their impacts (a compressed sparse row matrix, term by document).  An impact
depends on the term's frequency in the document and on the document's length; both are
known when the shard is written, so a search only multiplies and adds.

:func:`search` takes the queries in blocks of bounded size.  For every block a pass over
the shards' terms sums in how many documents each of its terms stands; then each shard is scored a
term at a time in a dense array with one number for each document, and gives
its best documents; those of all shards are merged.  Nothing is shuffled but the best of each shard.

A document's score is the sum over the query's terms, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
and m = 25 + ((75 * n * N) div L): N documents with a term, L terms in all, n in the document.

Defined cases: a null or empty text, as document or query, has no term: it is never found, and finds
nothing.  Rows that share a key are documents, or queries, of their own; a null key is a key, and comes last
among equal scores.  Texts of any length count whole.  Documents with equal scores go by key.  An empty table
of documents or queries gives an empty result.  Other columns are not looked at.  Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.common import SLICE_ROWS, Workspace, texts
from tidewell.llm.jaccard import all_hashes

TOP = 10
#: Terms of a shard, repeats included, at which it is closed; bytes of the queries' texts in a block.
SHARD_TERMS, BLOCK_BYTES = 1 << 20, 16 << 20

#: Fixed values of the contract: the characters that part terms.
APART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that part terms become spaces, A-Z become a-z.
TABLE = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))

INDEX = "terms binary, ends binary, rows binary, impacts binary"


def terms_of(text: str) -> np.ndarray:
    """A 64-bit hash of each term, in the text's order."""
    return all_hashes(text.encode().translate(TABLE))


def impacts_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (tf * 1_000_000_000) // (1000 * tf + 8 * m)


def shard_of(docs: list[np.ndarray], total: int, length: int) -> tuple[bytes, bytes, bytes, bytes]:
    """The columns of :data:`INDEX` for documents given by their terms' hashes; ``total`` documents of the corpus hold ``length`` terms."""
    held = [np.unique(d, return_counts=True) for d in docs]
    term = np.concatenate([t for t, _ in held])
    tf = np.concatenate([c for _, c in held]).astype(np.int64)
    size = [len(t) for t, _ in held]
    m = np.array([25 + 75 * len(d) * total // length for d in docs], np.int64)
    order = np.argsort(term, kind="stable")
    rows, term = np.repeat(np.arange(len(docs), dtype=np.uint32), size)[order], term[order]
    impact = impacts_of(tf, np.repeat(m, size))[order].astype(np.uint32)
    last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
    return term[last].tobytes(), (last + 1).astype(np.uint32).tobytes(), rows.tobytes(), impact.tobytes()


def write_index(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text", shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, int]:
    """(the written shards, the number of documents with a term)."""
    n = F.regexp_count(F.col(f"`{text}`"), F.lit(APART)).cast("long")
    counted = df.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    total, length = counted["total"], counted["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held, kind = [], [], 0, None

        def shard() -> pa.RecordBatch:
            row = [keys, *shard_of(docs, total, length)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.list_(kind)] + [pa.binary()] * 4, strict=True)], ["keys", "terms", "ends", "rows", "impacts"])

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for k, t in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    found = terms_of(t)
                    if len(found):
                        keys.append(k)
                        docs.append(found)
                        held += len(found)
                        if held >= shard_terms:
                            yield shard()
                            keys, docs, held = [], [], 0
        if docs:
            yield shard()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return work.write(rows.mapInArrow(run, f"`keys` array<{kind}>, {INDEX}"), "index"), total


def document_frequencies(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many documents each of the ``wanted`` terms stands (sorted hashes); 0 is left out."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, found = places(np.frombuffer(terms, np.uint64), held.value)
                total[found] += np.diff(np.frombuffer(ends, np.uint32).astype(np.int64), prepend=0)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "df"])

    rows = index.select("terms", "ends").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    return {int(wanted[r["at"]]): r["df"] for r in rows}


def places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where in ``terms``, where in ``wanted``) the values stand that both sorted arrays have."""
    at = np.searchsorted(terms, wanted)
    found = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, np.int64)
    return at[found], found


def best(scores: np.ndarray, keys: list, top: int) -> list[int]:
    """The rows of the ``top`` highest scores above 0, equal ones by key (null last)."""
    if len(scores) > top:
        least = scores[np.argpartition(scores, len(scores) - top)[len(scores) - top]]
        some = np.flatnonzero((scores >= least) & (scores > 0))  # all that are equal to the last one take part
    else:
        some = np.flatnonzero(scores > 0)
    return sorted(some.tolist(), key=lambda i: (-scores[i], keys[i] is None, keys[i] if keys[i] is not None else 0))[:top]


def weight(df: int, total: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def found_in(index: DataFrame, queries: list[tuple[object, str]], total: int, top: int, key: str, query_key: str, kinds: tuple[str, str], q_type: pa.DataType) -> DataFrame:
    """(q, query_key, key, score): the best of each shard for queries that fit on the driver; q is the query's number."""
    counted = [np.unique(terms_of(t), return_counts=True) for _, t in queries]
    wanted = np.unique(np.concatenate([t for t, _ in counted]))
    df = document_frequencies(index, wanted)
    weights = np.array([weight(df.get(t, 0), total) for t in wanted.tolist()], np.int64)
    plan = [(np.searchsorted(wanted, t), c.astype(np.int64)) for t, c in counted]
    held = index.sparkSession.sparkContext.broadcast((wanted, weights, plan, [k for k, _ in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, plan, ids = held.value
        for batch in batches:
            k_type = batch.column(0).type.value_type
            for i in range(batch.num_rows):
                keys, terms, ends, rows, impacts = (c[i].as_py() for c in batch.columns)
                ends, rows, impacts = np.frombuffer(ends, np.uint32), np.frombuffer(rows, np.uint32), np.frombuffer(impacts, np.uint32)
                at, found = places(np.frombuffer(terms, np.uint64), wanted)
                stop = np.zeros(len(wanted), np.int64)
                start = np.zeros(len(wanted), np.int64)
                stop[found] = ends[at]
                start[found] = np.where(at > 0, ends[np.maximum(at, 1) - 1], 0)
                out: list[tuple] = []
                for q, (places_, count) in enumerate(plan):
                    scores = np.zeros(len(keys), np.int64)
                    for p, times in zip(places_.tolist(), (count * weights[places_]).tolist(), strict=True):
                        a, b = start[p], stop[p]
                        if a < b:
                            scores[rows[a:b]] += impacts[a:b].astype(np.int64) * times
                    out += [(q, ids[q], keys[x], int(scores[x])) for x in best(scores, keys, top)]
                if out:
                    columns = [list(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], q_type), pa.array(columns[2], k_type), pa.array(columns[3], pa.int64())], ["q", query_key, key, "score"])

    return index.select("keys", "terms", "ends", "rows", "impacts").mapInArrow(run, f"q long, `{query_key}` {kinds[0]}, `{key}` {kinds[1]}, score long")


def search(index: DataFrame, total: int, queries: DataFrame, work: Workspace, key: str = "doc_id", query_key: str = "item_id", text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_key, rank (from 1), key and score of the ``top`` best documents of each query; ``total``: documents with a term."""
    kinds = queries.schema[query_key].dataType.simpleString(), index.schema["keys"].dataType.elementType.simpleString()
    rows = queries.select(F.col(f"`{query_key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.regexp_count("t", F.lit(APART)) > 0)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) if total else 0
    numbered = work.write(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, blocks)))), "queries")
    out = None
    for b in range(blocks):
        block = [(r["k"], r["t"]) for r in numbered.filter(F.col("block") == b).collect()]
        if not block:
            continue
        found = work.write(found_in(index, block, total, top, key, query_key, kinds, to_arrow_type(queries.schema[query_key].dataType)), f"found-{b}")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col(f"`{key}`").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(query_key, "rank", key, "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"`{query_key}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score long")
    return out
