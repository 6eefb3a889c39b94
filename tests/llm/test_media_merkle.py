import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import media, merkle, queries

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_container_round_trip(data):
    payload = media.padded(data)
    stored = media.mux(payload)
    t = media.sample_table(stored)
    assert media.demux(stored, t) == payload and (t["codec"], t["timescale"], t["duration"], t["samples"]) == ("raw ", 8000, len(payload), len(payload) // 576)
    assert t["keys"].tolist() == list(range(0, t["samples"], 16))


def test_other_containers():
    stored = media.mux(media.padded(b"x" * 20_000))
    # A free box before the rest moves the payload; the chunk offsets then point elsewhere, but the tables are read all the same.
    t = media.sample_table(media.box(b"free", b"abc") + stored)
    assert t["samples"] == 35
    wide = media.box(b"wide")
    assert media.sample_table(stored + wide)["duration"] == 35 * 576


def test_broken_containers(spark):
    good = media.mux(media.padded(b"abc"))
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"junk" * 9), (4, good[:-5]), (5, good[:300]), (6, good)], "id int, media binary")
    got = {r["id"]: r for r in media.probe_media(df, "media", "id", payload=True).collect()}
    assert [got[i]["codec"] for i in range(1, 7)] == [None] * 5 + ["raw "]
    k = got[6]["keyframes"][0]
    assert good[k["start"] : k["end"]] == media.padded(b"abc") == bytes(got[6]["payload"])


def test_hostile_containers(spark):
    """Tables that promise more than the file holds, and boxes without end, cost neither memory nor the job."""
    good = media.mux(media.padded(b"x" * 3000))
    at = good.index(b"stsz") + 8
    deep = b"".join(struct.pack(">I4s", 8 * (3000 - i), b"moov") for i in range(3000))
    stsc = good.index(b"stsc") + 16
    hostile = [good[:at] + struct.pack(">II", 1 << 20, 0xFFFFFFFF) + good[at + 8 :], good[:at] + struct.pack(">II", 1, 0xFFFFFFFF) + good[at + 8 :], deep, good[: stsc - 4] + struct.pack(">I", 0xFFFFFFF0) + good[stsc:], b"", b"\0" * 64]
    df = spark.createDataFrame([(i, x, "mine") for i, x in enumerate([good, *hostile])], "id int, media binary, codec string")
    got = {r["id"]: r for r in media.probe_media(df, "media", "id", payload=True).collect()}
    assert got[0]["payload"] == media.padded(b"x" * 3000) and all(got[i]["codec"] is None for i in range(1, 1 + len(hostile)))


def test_op4(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_media_columns(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        data = docs[r["doc_id"]].encode()
        p = media.padded(data)
        m = media.mux(p)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest())
        assert r["feature"].startswith(f"raw;{len(p)}/8000;{len(p) // 576};")


def test_store_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "z"), (1, "", "z"), (1, "é" * 300, "z")], "doc_id long, text string, n_bytes string")
    got = media.store_media(df, "text", "media", "doc_id").collect()
    assert [r["n_bytes"] for r in got] == [0, 0, 600] and bytes(got[0]["media"]) == bytes(got[1]["media"])
    assert media.store_media(df.limit(0), "text", "media", "doc_id").count() == 0


# ---- Merkle trees, written again in plain Python


def tree(text):
    sha = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    out, section = [], []
    for line in text.split("\n"):
        leaves = ".".join(sha(line[i : i + 64], 8) for i in range(0, len(line), 64))
        section.append(leaves)
        if not leaves or sha(leaves, 16).endswith("0"):
            out.append(section)
            section = []
    ended = bool(section)
    sections = [*out, section] if ended else out
    root = hashlib.sha256(",".join(sha(",".join(sha(p, 16) for p in s), 16) for s in sections).encode()).hexdigest()
    return f"{root}:{';'.join(','.join(s) for s in sections)}"


def like(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({w for w in f[65:].replace(",", ".").replace(";", ".").split(".") if w} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_op5(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op5_merkle_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (tree(a), tree(e))
        assert abs(r["near_edited"] - like(tree(a), tree(e))) < 1e-12 and abs(r["near_next"] - like(tree(a), tree(b))) < 1e-12


def test_pairs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    rows = [(i * 7, f"t{i}") for i in range(40)] + [(None, "none"), (14, "t2"), (14, "a")]
    pairs = merkle.pair_with_next(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(((r["k"], r["t"], r["next_k"], r["next_t"]) for r in pairs), key=repr) == sorted(((*a, *b) for a, b in zip(order, order[1:] + order[:1], strict=True)), key=repr)
    one = merkle.pair_with_next(spark.createDataFrame([(5, "x")], "k long, t string"), "k", "t").collect()
    assert [(r["next_k"], r["next_t"]) for r in one] == [(5, "x")]
    assert merkle.pair_with_next(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0


def test_edits_are_located(spark):
    a = "\n".join(f"paragraph {i} " + "x" * 50 for i in range(30))
    b = a.replace("paragraph 17", "PARAGRAPH 17")
    df = spark.createDataFrame([(a, b), (a, a), (None, "")], "a string, b string")
    df = merkle.add_fingerprint(merkle.add_fingerprint(df, "a", "fa"), "b", "fb")
    got = df.select(merkle.differing(F.col("fa"), F.col("fb")).alias("d"), (F.col("fa") == F.col("fb")).alias("same")).collect()
    assert len(got[0]["d"]) == 1 and got[1]["d"] == [] and [r["same"] for r in got] == [False, True, True]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_equal_short_leaves_are_told_apart(spark):
    seen = {}
    for i in range(1_000_000):
        a, b = seen.setdefault(hashlib.sha256(f"text {i}".encode()).hexdigest()[:8], f"text {i}"), f"text {i}"
        if a != b:
            break
    df = spark.createDataFrame([(a, b), (f"x\n{a}", f"x\n{b}")], "a string, b string")
    df = merkle.add_fingerprint(merkle.add_fingerprint(df, "a", "fa"), "b", "fb")
    for r in df.select("fa", "fb", merkle.likeness(F.col("fa"), F.col("fb")).alias("near"), merkle.differing(F.col("fa"), F.col("fb")).alias("d")).collect():
        assert a != b and r["fa"][:64] != r["fb"][:64] and r["near"] < 1 and len(r["d"]) == 1


def track(number, codec, scale, sizes, place, keys=None, wide=False):
    b, f, u = media.box, media.full, lambda *v: struct.pack(f">{len(v)}I", *v)
    stbl = [f(b"stsd", 0, u(1), b(codec, bytes(28))), f(b"stts", 0, u(1, len(sizes), 10) if sizes else u(0)), f(b"stsz", 0, u(0, len(sizes), *sizes))]
    stbl += [f(b"stsc", 0, u(1, 1, len(sizes), 1) if sizes else u(0))]
    stbl += [f(b"co64", 0, struct.pack(">IQ", 1, place)) if wide else f(b"stco", 0, u(1, place) if sizes else u(0))]
    stbl += [f(b"stss", 0, u(len(keys), *keys))] if keys else []
    mdhd = f(b"mdhd", 0, u(0, 0, scale, 7, 0))
    return b(b"trak", f(b"tkhd", 7, u(0, 0, number, 0)), b(b"mdia", mdhd, b(b"minf", b(b"stbl", *stbl))))


def test_every_track_has_its_own_tables(spark):
    audio, video = track(1, b"mp4a", 8000, [3, 3, 3], 8), track(2, b"avc1", 90000, [5, 6, 7, 8], 17, keys=[1, 3], wide=True)
    data = media.box(b"mdat", bytes(range(40)))
    rows = [(1, data + media.box(b"moov", audio, video)), (2, data + media.box(b"moov", video, audio)), (3, data + media.box(b"moov", audio, media.box(b"trak")))]
    got = {r["id"]: r for r in media.probe_media(spark.createDataFrame(rows, "id int, media binary"), "media", "id", payload=True).collect()}
    sound = ("mp4a", 8000, 30, 3, [(8, 11), (11, 14), (14, 17)])
    film = ("avc1", 90000, 40, 4, [(17, 22), (28, 35)])
    plain = lambda t: (t["codec"], t["timescale"], t["duration"], t["samples"], t["keyframes"] and [tuple(k) for k in t["keyframes"]])
    assert [plain(t) for t in got[1]["tracks"]] == [sound, film] and plain(got[1]) == sound and bytes(got[1]["payload"]) == data[8:17]
    assert [plain(t) for t in got[2]["tracks"]] == [film, sound] and plain(got[2]) == film and bytes(got[2]["payload"]) == data[17:43]
    assert [plain(t) for t in got[3]["tracks"]] == [sound, (None,) * 5]


def test_fragments():
    b, f, u = media.box, media.full, lambda *v: struct.pack(f">{len(v)}I", *v)
    moov = b(b"moov", track(1, b"mp4a", 8000, [], 0), track(2, b"avc1", 90000, [], 0), b(b"mvex", f(b"trex", 0, u(1, 1, 10, 4, 0)), f(b"trex", 0, u(2, 1, 20, 0, 0x10000))))
    make = lambda n: b(b"moof", b(b"traf", f(b"tfhd", 0x20000, u(1)), f(b"trun", 1, u(3, n + 8))), b(b"traf", f(b"tfhd", 0x20000, u(2)), f(b"trun", 0x205, u(2, n + 20, 0, 6, 5))))
    moof = make(len(make(0)))
    at = len(moov) + len(moof) + 8
    sound, film = media.sample_tables(moov + moof + b(b"mdat", bytes(23)))
    assert (sound["samples"], sound["duration"], sound["offsets"].tolist(), sound["keys"].tolist()) == (3, 30, [at, at + 4, at + 8], [0, 1, 2])
    assert (film["samples"], film["duration"], film["offsets"].tolist(), film["sizes"].tolist(), film["keys"].tolist()) == (2, 40, [at + 12, at + 18], [6, 5], [0])


def test_one_bucket_never_gets_all_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 1)
    rows = [(i, f"t{i}") for i in range(4200)] + [(1 << 50, "far")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for some in (rows, [(None, t) for _, t in rows[:400]]):
            pairs = merkle.pair_with_next(spark.createDataFrame(some, "k long, t string"), "k", "t")
            got = pairs.withColumn("p", F.spark_partition_id()).collect()
            assert len(got) == len(some) and sorted(r["next_t"] for r in got) == sorted(t for _, t in some)
            assert max(sum(r["p"] == p for r in got) for p in range(4)) < 0.5 * len(some)
            nexts = {r["t"]: r["next_t"] for r in got}
            t, seen = some[0][1], set()
            while t not in seen:
                seen.add(t)
                t = nexts[t]
            assert len(seen) == len(some)  # one ring through all rows
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
