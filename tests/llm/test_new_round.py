"""Phrases, bottom-k sketches and ranked search against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import bottomk, phrases, ranked
from tidewell.llm.common import Workspace
from tidewell.llm.queries import QUERIES
from tidewell.llm.sql import LOWER, UPPER

LOW = str.maketrans(UPPER, LOWER)


def brute_phrases(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in cand.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)}
    return out


def phrase_rows():
    rng = random.Random(5)
    words = ["a", "b", "ab", "B", "ça", "x\x00y", "\u0085", "word", "日本", "q" * 70]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0c"]) for _ in range(rng.randrange(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None, "EN"]), "clash"))
    rows += [(None, None, "en", "x"), (7, "", None, "x"), (8, "a a a a a a", "en", "x"), (8, "a a a a a a", "en", "x"), (9, ".;:!", "de", "x"), (10, " ".join(["b a"] * 40_000), "de", "x")]
    return rows


@pytest.mark.parametrize(("cell_bits", "block"), [(28, 1_200_000), (16, 7)])
def test_phrases(spark, monkeypatch, cell_bits, block):
    rows = phrase_rows()
    # Small chunks, blobs and held languages reach the paths of large inputs.
    monkeypatch.setattr(phrases, "LANGUAGES", 1)
    monkeypatch.setattr(phrases, "SEEN", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank string").repartition(3)
    got = phrases.collocations(df, Workspace(spark, "t"), least=20, cell_bits=cell_bits, block_phrases=block)
    want = brute_phrases([(r[2], r[1]) for r in rows], 20)
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 30
    assert phrases.collocations(df, Workspace(spark, "t"), least=20, top=3).count() == 3 * 4


def test_phrases_in_several_passes(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(r[2], r[1]) for r in rows] * 8, "lang string, text string")
    w = Workspace(spark, "t")
    f, n = phrases.counted(df, w, "lang", "text", 160, 16, 1000, 1 << 20)  # 2 ** 16 cells: more than one pass
    assert df.selectExpr("sum(octet_length(text))").first()[0] // 4 > 1 << 16
    want = {x[:1] + x[2:4] for x in brute_phrases([(r[2], r[1]) for r in rows], 20)}
    assert want <= {(r["lang"], r["phrase"], r["f"] // 8) for r in f.collect()}
    assert {r["lang"] for r in n.collect()} == {"en", "de", "EN", "und"}


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), Workspace(spark, "t")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string"), Workspace(spark, "t")).count() == 0


def test_phrases_guards():
    s = phrases._Scanner(["a b", "b a", "a", "b", "a b a"])
    # "ab" is a word of its own, "c" and line ends are guards
    assert s.count(b"a b a b ab a c b\nb a").tolist() == [2, 2, 4, 4, 1]
    codes = phrases.symbols(70_000)
    assert codes.shape == (70_001, 3)
    assert len({tuple(c) for c in codes.tolist()}) == 70_001
    assert not set(codes[1:, 0].tolist()) & set(codes[:, 1:].ravel().tolist())


def brute_components(rows, words=4):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append(frozenset({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i)), k == least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    rows = [(None, "null key one two"), (None, None), (3, ""), (4, " \n\t"), (5, "Just three words"), (5, "just THREE words"), (None, "just three words")]
    license_ = [f"lic{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 30, 100, 140, 300, 900]))]
        if g % 3 == 0:
            base = license_ + base
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.05, 0.08]))):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            rows.append((rng.randrange(10_000), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bottomk(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, class string, sig int")
    got = bottomk.link(df, Workspace(spark, "t"), block=4)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute_components(rows)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=repr) == want
    assert bottomk.link(df.limit(0), Workspace(spark, "t")).count() == 0


def test_bottomk_cells(spark):
    """Members of one list that the first rounds leave apart: chains of variants around a text that nobody is close to."""
    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(120)], []
    for v in range(10):
        own = list(base)
        for i in rng.sample(range(120), 12):
            own[i] = f"v{v}-{i}"
        for c in range(4):
            copy = list(own)
            copy[rng.randrange(120)] = f"c{v}-{c}"
            rows.append((100 * c + v, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in bottomk.link(df, Workspace(spark, "t"), block=3).collect()), key=repr)
    assert got == brute_components(rows)


def test_bottomk_bounds():
    assert sum(math.comb(128, x) * 0.8**x * 0.2 ** (128 - x) for x in range(bottomk.need(128, 80))) <= 1e-10
    rng = np.random.default_rng(3)
    for n in (5, 50, 110, 128, 129, 160, 1000):
        for share in (0.8, 0.82, 0.95):
            union = rng.integers(0, 1 << 62, n, np.int64).astype(np.uint64)
            both = int(np.ceil(share * n))
            one = (n - both) // 2
            a, b = np.sort(union[: both + one]), np.sort(np.append(union[:both], union[both + one :]))
            sa, sb = a[:128], b[:128]
            assert bottomk.may_be_similar(sa, sb, len(a), len(b), 128, 80)
            overlap = len(np.intersect1d(sa, sb))
            assert overlap >= max(bottomk.least_overlap(len(a), 128, 80), bottomk.least_overlap(len(b), 128, 80)) or min(len(a), len(b)) <= 128
            assert bottomk.prefix(len(a), 128, 80) >= 1
            differ = int(np.bitwise_count(bottomk.parity(sa) ^ bottomk.parity(sb)).sum())
            assert differ <= len(sa) + len(sb) - 2 * overlap


def brute_ranked(docs, queries, top=10):
    term = re.compile(ranked.APART)
    held = [(k, Counter(term.findall((t or "").translate(LOW)))) for k, t in docs]
    held = [(k, c) for k, c in held if c]
    total, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scores = []
        for k, c in held:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in term.findall((text or "").translate(LOW)) if t in c)
            if s > 0:
                scores.append((-s, k is None, k or 0, k))
        out += [(q, i, k, -s) for i, (s, _, _, k) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 50, 1 << 20])
def test_ranked(spark, shard):
    rng = random.Random(4)
    words = ["Foo", "bar", "BAZ", "ÉTÉ", "été", "x_y", "don't", "日本", "7up", "foo\x7fbar", "z" * 90]
    docs = [(rng.randrange(300), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for _ in range(200)]
    docs += [(None, "foo bar"), (None, "foo bar"), (1, None), (2, ""), (3, "-- !!"), *[(1000 + i, "same text foo") for i in range(30)], (5, "foo " * 3000)]
    queries = [(1, "foo bar foo"), (1, "étÉ 日本"), (None, "same text"), (2, None), (3, ""), (4, "nowhere"), (5, "SAME x y")]
    w = Workspace(spark, "t")
    index, total = ranked.write_index(spark.createDataFrame([(k, t, "s", 1) for k, t in docs], "doc_id long, text string, terms string, rank int").repartition(3), w, shard_terms=shard)
    q = spark.createDataFrame([(k, t, 0.5) for k, t in queries], "item_id int, text string, score double")
    got = ranked.search(index, total, q, w)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["item_id int", "rank int", "doc_id bigint", "score bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranked(docs, queries)
    # Several blocks of queries give the same.
    assert sorted((tuple(r) for r in ranked.search(index, total, q, w, block_bytes=8).collect()), key=repr) == brute_ranked(docs, queries)
    assert ranked.search(index, total, q.limit(0), w).count() == 0


def test_ranked_nothing(spark):
    w, q = Workspace(spark, "t"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for rows in ([], [(1, None), (2, "...")]):
        index, total = ranked.write_index(spark.createDataFrame(rows, "doc_id long, text string"), w)
        assert total == 0
        assert ranked.search(index, total, q, w).count() == 0


@pytest.mark.parametrize("name", ["op8_jaccard_components", "op11_phrases", "op12_bottomk_components", "op13_ranked_search"])
def test_sql(spark, name):
    import duckdb

    from tidewell.llm.sql import ORACLE_SQL

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), c.sql(ORACLE_SQL[name])
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
