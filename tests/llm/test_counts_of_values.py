"""Counts of retained values in packed rows, with values that are common in a chunk apart."""

import random
from collections import Counter

import numpy as np
from test_new_round import brute_components

from tidewell.llm import bottomk
from tidewell.llm.common import Workspace


def test_packed_counts(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "CHUNK", 7)
    monkeypatch.setattr(bottomk, "COMMON", 4)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 48, 60, np.int64).astype(np.uint64)
    rows, want = [], []
    for i in range(90):
        v = np.sort(np.unique(np.append(pool[rng.integers(0, 60, 5) * (i % 3 == 0)], rng.integers(0, 1 << 48, 6, np.int64).astype(np.uint64))))
        rows.append((i, 150, (v >> np.uint64(16)).astype(np.uint32).tobytes(), v.astype(np.uint16).tobytes()))
        want += [(i, int(x)) for x in v]
    held = spark.createDataFrame(rows, "class long, size long, high binary, low binary").coalesce(1)
    packed = bottomk.packed(held, 128, 80, 3).cache()
    assert packed.count() <= 4 * -(-90 // 7)  # a row for each chunk and part, and one for the common ones; not one for each value
    found = bottomk.counted(packed).collect()
    n = Counter(v for _, v in want)
    common = {r.v: r.n for r in found if r["class"] is None}
    assert common and all(n[v] == m for v, m in common.items())
    got = [(r["class"], r.v, r.n) for r in found if r["class"] is not None] + [(r["class"], r.v, common[r.v]) for r in bottomk.common_members(packed).collect()]
    assert sorted(got) == sorted((c, v, n[v]) for c, v in want if n[v] > 1)
    assert {r.least for r in found if r["class"] is not None} == {bottomk.least_overlap(150, 128, 80)}


def test_link_with_common_values(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "CHUNK", 16)
    monkeypatch.setattr(bottomk, "COMMON", 3)
    monkeypatch.setattr(bottomk, "PART_VALUES", 500)
    rng = random.Random(6)
    line = [f"line{i}" for i in range(30)]
    rows = []
    for i in range(40):
        own = [f"w{i}-{j}" for j in range(rng.choice((4, 90, 160)))]
        for c in range(3):
            copy = list(own)
            copy[rng.randrange(len(copy))] = f"c{i}-{c}"
            rows.append((3 * i + c, " ".join(line + copy)))
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (None, rows[0][1])], "doc_id long, text string")
    got = sorted((tuple(r) for r in bottomk.link(df, Workspace(spark, "t"), block=4).collect()), key=repr)
    assert got == brute_components([*rows, (500, None), (501, ""), (None, rows[0][1])])
