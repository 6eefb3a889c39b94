"""Similar sets that differ in rare items only are compared as groups, and every pair is still found with its own count."""

import random

import pytest

from tidewell.operators import matching
from tidewell.workspace import Workspace


def brute(sets, percent):
    found = set()
    for a in sets:
        for b in sets:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and 100 * both >= percent * all_:
                found.add((a, b, both, round(both / all_, 6)))
    return found


@pytest.mark.parametrize("members", [3, 512])
def test_groups_of_sets(spark, monkeypatch, members):
    written = {}
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    monkeypatch.setattr(matching, "MEMBERS", members, raising=False)
    rng = random.Random(4)
    sets = {}
    for k in range(400):
        s = {"all", rng.choice(["x", "y"]), rng.choice(["en", "de", "fr"]), f"n{rng.randrange(250)}"}  # numbers that one to five sets have
        if rng.random() < 0.3:
            s |= {"more", f"m{k % 40}"}
        sets[k] = s
    for k in range(400, 440):
        sets[k] = set(sets[k - 400])  # copies
    sets |= {440: {"all"}, 441: {"alone"}, 442: {"alone"}, 443: {f"l{i}" for i in range(90)} | {"all"}, 444: {f"l{i}" for i in range(80)} | {"all", "x"}}
    rows = [(k, w) for k, s in sets.items() for w in s]
    df = spark.createDataFrame(rows, "k int, w string")
    for percent in (40, 60, 100):
        written.clear()
        got = [tuple(r) for r in matching.similar_sets(df, "k", "w", percent).collect()]
        want = brute(sets, percent)
        assert len(got) == len(set(got)) and set(got) == want
        assert len(want) > (1000 if percent < 100 else 40)
        assert written["candidates"].count() < 200
