"""Tokenizers, packing and token files against the libraries and by round trips."""

import base64
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import bpe, packing, queries, token_files
from tidewell.llm.common import Workspace
from tidewell.llm.tokens import CachedTokenizer

SF = "/root/testdata/sf0.001"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD_TEXTS = [None, "", " ", "\n\n  x", "a" * 3000, "ab" * 900 + "!", "日本語 💥 é́\x1c\x85 x", "<|endoftext|> it's", "\xa0 　y", "\x00"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abest 'Thn\n.,0", max_size=200))
def test_bpe_equals_the_library(encoder, text):
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_of_long_pieces(encoder):
    for t in ODD_TEXTS[1:] + ["thethe" * 5000, "\n" * 999, "=" * 2000]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == REFERENCE.encode_ordinary(t)
    with pytest.raises(ValueError):
        encoder.decode(struct.pack("<I", 999_999))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenizer_equals_the_library(name, spark):
    mine = CachedTokenizer(P.path(name), cache_bytes=100_000)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(max_size=40) | st.text(alphabet="aBé ß'sT\n1.²", max_size=60), max_size=4))
    def check(texts):
        want = [np.array(e.ids, "<u4").tobytes() for e in mine.whole.encode_batch(texts, add_special_tokens=False)]
        assert mine.encode(texts) == want

    check()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for t in ODD_TEXTS]
    assert mine.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in mine.whole.encode_batch(texts, add_special_tokens=False)]


def test_caches_are_bounded_in_bytes():
    """Long texts without spaces, each unlike the others, leave nothing in the caches; many words fill them to their bound."""
    r = np.random.default_rng(0)
    unspaced = ["".join(map(chr, r.integers(0x4E00, 0x9000, 4000))) for _ in range(20)]
    many = [" ".join(f"w{a}x{b}" for b in range(100)) for a in range(60)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        mine = CachedTokenizer(P.path(name), cache_bytes=200_000)
        want = [np.array(e.ids, "<u4").tobytes() for e in mine.whole.encode_batch(unspaced + many, add_special_tokens=False)]
        assert [x for t in unspaced + many for x in mine.encode([t])] == want
        assert mine.held_bytes <= 200_000 and max(map(len, mine.cache)) <= 64 and 500 < len(mine.cache) < 1000
    small = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cache_bytes=100_000)
    for t in unspaced + many:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == REFERENCE.encode_ordinary(t)
        assert small.held_bytes <= 100_000 + 400 and max(map(len, small.units), default=0) <= 64


def odd_rows(spark):
    rows = [(i if i != 3 else None, t, f"x{i}") for i, t in enumerate(ODD_TEXTS)] + [(5, "again", "y"), (5, "again", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing extra column


def test_bpe_operator(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = odd_rows(spark).select("doc_id", "text")
    got = bpe.decode_ids(bpe.encode_texts(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for t in [*ODD_TEXTS, "again", "again"])
    assert bpe.encode_texts(df.limit(0), path, P.PATTERN).count() == 0


def test_op3(spark):
    got = {r["doc_id"]: r for r in queries.op3_bpe_roundtrip(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = REFERENCE.encode_ordinary(r["text"])
        import hashlib

        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["ids_sha256"], mine["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.sampled_from([64, 2048]))
def test_pack(sizes, length):
    pieces = packing.pack(sizes, length)
    of = {}
    for d, start, n, seq, offset in pieces:
        assert n > 0
        of.setdefault(("d", d), []).append((start, n))
        of.setdefault(("s", seq), []).append((offset, n))
    for (kind, i), parts in of.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        if kind == "d":
            assert at == sizes[i]
        else:
            assert at == length or at < length and at & (at - 1) == 0
    assert sum(n for _, _, n, _, _ in pieces) == sum(sizes)


def test_packing_balances_costs():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 1500, 400).tolist()
    cost = {}
    for _, _, n, seq, _ in packing.pack(sizes):
        cost[seq] = cost.get(seq, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    costs = np.array(sorted(cost.values())[12:])  # without the few short sequences
    firstfit, room, load = [], 2048, 0.0  # documents one after another
    for n in sizes:
        while n:
            take = min(n, room)
            load, room, n = load + take + packing.QUADRATIC * take * take, room - take, n - take
            if not room:
                firstfit.append(load)
                room, load = 2048, 0.0
    assert costs.std() < np.std(firstfit)


def check_pieces(pieces, docs, end):
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, ids in docs.items():
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids) // 4 + 1)
            whole = ids + struct.pack("<I", end)
            assert r["ids_crc32"] == zlib.crc32(whole[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4 + 1
    for parts in seqs.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_op6(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    whole = CachedTokenizer(P.path("word_bpe_49k.json")).whole
    docs = {r["doc_id"]: np.array(e.ids, "<u4").tobytes() for r, e in zip(rows, whole.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True)}
    check_pieces(queries.op6_cost_packing(spark, SF).collect(), docs, 1)


def test_packing_of_odd_rows(spark):
    got = packing.pack_documents(odd_rows(spark), P.path("word_bpe_49k.json"), block_tokens=100).collect()
    assert {r["doc_id"] for r in got} == {None, *range(10)} - {3} and sum(r["doc_id"] == 5 and r["start"] == 0 for r in got) == 3
    assert packing.pack_documents(odd_rows(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_values_round_trip(values):
    x = np.array(values, np.uint32)
    controls, data = token_files.encode_values(x)
    assert len(controls) == -(-len(values) // 4)
    assert token_files.decode_values(controls, data, len(values)).tolist() == values


def test_op10(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    whole = CachedTokenizer(P.path("byte_bpe_50k.json")).whole
    got, at = {r["doc_id"]: r for r in queries.op10_token_files(spark, SF).collect()}, 0
    for r, e in zip(rows, whole.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_token_files_of_odd_rows(spark):
    df = odd_rows(spark).select("doc_id", "text", F.lit("x").alias("start"))
    blocks = token_files.token_blocks(df, P.path("byte_bpe_50k.json"), block_ids=50)
    got = token_files.read_documents(Workspace(spark, "t").write(blocks, "blocks")).orderBy("start").collect()
    assert got[0]["doc_id"] is None and len(got) == 12 and [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()
    assert all(bytes(r["ids"]).endswith(struct.pack("<I", 2)) for r in got)
    empty = Workspace(spark, "t").write(token_files.token_blocks(df.limit(0), P.path("byte_bpe_50k.json")), "blocks")
    assert token_files.read_documents(empty).count() == 0
