"""Texts are scanned as often whatever their size and however many candidates they have."""

import random

import numpy as np

from tidewell.llm import phrases
from tidewell.llm.common import Workspace


def test_scans_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50_000, raising=False)
    rng = random.Random(3)
    rows = [("en" if i % 3 else "de", " ".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(600)]
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInPandas(counting, "lang string, text string")
    # 2 ** 16 cells for more text, and some 500 candidates in blocks of 20.
    f, n = phrases.counted(df, Workspace(spark, "t"), "lang", "text", 30, 16, 20, 1 << 20)
    got = {(r["lang"], r["phrase"]): r["f"] for r in f.collect()}
    want = {}
    for lang, text in rows:
        w = text.split()
        for k in range(1, 5):
            for i in range(len(w) - k + 1):
                key = lang, " ".join(w[i : i + k])
                want[key] = want.get(key, 0) + 1
    assert {k: x for k, x in got.items() if x >= 30} == {k: x for k, x in want.items() if x >= 30}
    assert len(got) > 500 and {r["lang"]: r["n"] for r in n.collect()} == {"en": 120_000, "de": 60_000}
    assert seen.value <= 3 * len(rows)


def test_filter_holds_its_cells():
    rng = np.random.default_rng(1)
    for bits, n in ((16, 3), (16, 60_000), (34, 0), (34, 50_000)):
        cells = rng.choice(1 << bits, n).astype(np.int64) if n else np.zeros(0, np.int64)
        sketch = phrases._Sketch(bits)
        sketch.room(n)
        sketch.add(cells)
        assert sketch.has(cells.astype(np.uint64) << np.uint64(64 - bits)).all()
        others = rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
        assert sketch.has(others).mean() < max(0.03, 1.1 * len(set(cells.tolist())) / 2**bits)
