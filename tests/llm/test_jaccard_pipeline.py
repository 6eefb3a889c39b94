"""The similarity join against all pairs, components against union-find, and the pipeline against its parts."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidewell.llm import jaccard, queries
from tidewell.llm.common import Workspace
from tidewell.llm.components import components

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """{position: (size, component)} by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows)]


def test_signatures_miss_no_pair():
    r = np.random.default_rng(0)
    for size in [*range(1, 40), 57, 80, 133, 400, 1000]:
        for _ in range(15):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            drop = r.integers(0, len(a) // 5 + 1)
            b = np.unique(np.append(r.permutation(a)[drop:], r.integers(0, 2**63, r.integers(0, len(a) // 5 + 1)).astype(np.uint64)))
            if jaccard.similar(a, b):
                assert set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())


def test_op8(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard_components(spark, SF).collect()]
    assert sorted(got) == sorted(brute(rows))


def near_copies(seed, groups=6, copies=12):
    """Chains and stars of near copies around the threshold, copies, passages that many share, and odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice((6, 20, 60, 150)))]
        text = list(base)
        for k in range(copies):
            if k % 4 == 3:
                text = list(base)
            for _ in range(max(1, len(text) // 60)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append(" ".join(text))
            if k % 5 == 0:
                rows.append(" ".join(text).upper())
    for _ in range(20):
        rows.append(" ".join(passage + [r.choice(words) for _ in range(25)]))
    rows += ["", " \n", "one", "one", "two words", "a b c d", "A b c d", "e f g h i", "x" * 5000]
    out = [(i, t) for i, t in enumerate(rows)]
    r.shuffle(out)
    return [*out, (None, "null key alone here it stands"), (None, "one"), (7, None), (7, rows[0])]


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    for _ in range(400):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.append(r.permutation(a)[r.integers(0, len(a) // 5 + 1) :], r.integers(0, 2**63, r.integers(0, len(a) // 5 + 1)).astype(np.uint64)))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        m = min(len(x), len(y))
        differ = np.bitwise_count(jaccard.folded([x], m) ^ jaccard.folded([y], m)).sum()
        assert differ <= len(np.setxor1d(a, b))
        if jaccard.similar(a, b):
            assert jaccard.may_be_similar(differ, np.int64(len(a)), np.int64(len(b)), 80)


def test_hashes_of_words():
    words = [b"x", b"ab", b"ba", b"\xc3\xa9", b"y" * 70_000, b"z" * 65_536, b"x"]
    got = jaccard.all_hashes(b" \n" + b" \t".join(words) + b" " * 70_000)
    assert len(got) == 7 and got[0] == got[6] and len(set(got.tolist())) == 6
    assert jaccard.all_hashes(b"").tolist() == [] and jaccard.all_hashes(b"ab")[0] == got[1]


def test_words_made_to_collide_stay_apart(spark):
    """A Thue-Morse word and its complement, which have one hash by any polynomial modulo 2**64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_a_set_that_is_sparse_is_dealt_anew():
    for size in (6, 14, 40):  # all elements in one partition of the first hash
        i = jaccard.band_of(size, 80)
        n = np.prod([np.lcm.reduce([jaccard.parts(b, 80)[0] * jaccard.parts(b, 80)[1] for b in (i - 1, i, i + 1, i + 2)])])
        a = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(n)
        b = a[1:]
        assert jaccard.similar(a, b) and set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())
        far = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(n) + np.uint64(n << 20)
        assert not set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(far).tolist())


@pytest.mark.parametrize(("seed", "stars", "block"), [(1, 2, 2048), (2, 1, 3), (3, 2, 2)])
def test_link_equals_all_pairs(spark, monkeypatch, seed, stars, block):
    monkeypatch.setattr(jaccard, "STARS", stars)
    rows = near_copies(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # groups of signatures then span batches
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class int").repartition(3)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df, Workspace(spark, "t"), block=block).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_link_of_an_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string"), Workspace(spark, "t")).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"), "c").collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            todo += [m for m in near[todo.pop()] if m not in seen and not seen.add(m)]
        assert got[n] == min(seen)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, kept = Workspace(spark, "t"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(work.write(stage(spark, kept[-1], SF), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "secrets", "packing"]
    assert all(k.dtypes == docs.dtypes for k in kept[1:-1])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[2]) > 0.8 * len(ids[0])
    before = [(r["doc_id"], r["text"]) for r in kept[2].collect()]
    assert ids[3] == {k for k, _, c in brute(before) if k == c}
    assert ids[4] == ids[3] == ids[5]
    from tidewell.llm import secrets

    texts = {r["doc_id"]: r for r in kept[4].collect()}
    for r in kept[3].collect():
        after = texts[r["doc_id"]]
        assert after["n_chars"] == len(after["text"]) and secrets.base_spans(after["text"]) == []
        if not secrets.find([r["text"]], secrets.default_network())[0]:
            assert after["text"] == r["text"]
    whole = {(r["doc_id"], r["start"], r["length"]) for r in kept[5].collect()}
    assert {(r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, SF).collect()} == whole


def test_copies_go_by_row(spark):
    same, other = "one and the same text of six words", "a clean text that stands alone here"
    rows = [(None, same, 1), (None, same, 2), (3, same, 3), (3, same, 4), (5, same, 5), (5, other, 6), (None, "no copies of this one are there", 7), (None, "", 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1)
    got = corpus_pipeline.one_of_each_group(spark, df, SF)
    assert got.columns == df.columns and sorted(r["n_chars"] for r in got.collect()) == [3, 6, 7, 8, 9]
    nulls = corpus_pipeline.one_of_each_group(spark, df.filter("doc_id is null"), SF)
    assert sorted(r["n_chars"] for r in nulls.collect()) == [1, 7, 8, 9]


ODD = [(1, "a plain text about the weather of today in the north", 1), (None, "another plain text that nobody has written before in words", 2), (None, None, 3), (2, "", 4), (3, "12 34 !", 5), (4, "word " * 30_000, 6), (5, "a plain text about the weather of today in the north", 7), (5, "a plain text about the weather of today in the north", 8), (6, "my key ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8 stays here", 9)]


@pytest.mark.parametrize("clash", ["_score _row _text _letter", "score lang_pred component_id class", "sig k r g"])
def test_stages_of_odd_rows(spark, clash):
    """Nulls, empty and long texts, repeated rows, names that clash, and empty tables, through every stage."""
    names = clash.split()
    df = spark.createDataFrame([(i, t, "en", "s", n, *["x"] * len(names)) for i, t, n in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    stages, left = dict(corpus_pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, df, SF)
        rows = out.collect()
        assert out.columns == df.columns and all(r[n] == "x" for r in rows for n in names)
        left[name] = sorted(r["n_chars"] for r in rows) if name != "secrets" else len(rows)
        assert stages[name](spark, df.limit(0), SF).count() == 0
    assert left["toxicity"] == list(range(1, 10)) and left["secrets"] == 9
    assert set(left["language"]) == {1, 2, 6, 7, 8, 9} and left["near_copies"] in ([1, 2, 3, 4, 5, 6, 9], [1, 2, 3, 4, 5, 6, 9])
    packed = stages["packing"](spark, df, SF)
    assert packed.select("doc_id").distinct().count() == 7 and stages["packing"](spark, df.limit(0), SF).count() == 0


def test_links_are_all_pairs(spark):
    rows = near_copies(1, groups=3)
    sets = [shingle_set(t) for _, t in rows]
    near = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = [(k, len(sets[i]), sum(1 for j in range(len(rows)) if j != i and near(i, j))) for i, (k, _) in enumerate(rows)]
    pairs, counted = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t"), block=8)
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in counted.collect()), key=repr) == sorted(want, key=repr)
    distinct = list({frozenset(s) for s in sets if s})
    assert pairs.count() == pairs.distinct().count() == sum(1 for i, a in enumerate(distinct) for b in distinct[:i] if 100 * len(a & b) >= 80 * len(a | b))
