import re

import pytest

from fathomline.llm import near_copies as nc


def brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    base = " ".join(f"w{k * k % 97}x{k}" for k in range(200))
    rows = [(9, base), (3, base.replace("w1x1 ", "ZZ ")), (4, base.upper()), (5, None), (6, " "), (7, "a b"), (8, "A  B"), (None, base), (2, "other"), (2, "other"), (2, base), (1, "solo"), (1, "else")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in nc.near_copies(df).collect()))
    assert got == [(0, 2), (1, 1), (1, 1), (2, 2), (2, 2), (2, 2), (3, 2), (4, 2), (5, 5), (6, 5), (7, 7), (8, 7), (9, 2)]
    assert nc.near_copies(df.limit(0)).count() == 0
    kept = nc.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "else"), (1, "solo"), (2, "other"), (2, base), (5, None), (7, "a b")]
    assert nc.keep_one(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, base), (None, base), (None, base + " end"), (None, "lone")], "doc_id long, text string")
    assert nc.keep_one(nameless).count() == 2


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, long[: len(long) // 2]), (4, " " * 2_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nc.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def edited(base, places, name):
    return " ".join(f"e{name}x{k}" if k in places else w for k, w in enumerate(base))


def test_copies_of_a_middle_id_that_are_unlike_each_other(spark):
    import random

    r = random.Random(7)
    base = [f"w{k}" for k in range(304)]
    rows = [(i, edited(base, sorted(r.sample(range(4, 300), 6)), i)) for i in range(400) if i != 200] + [(200, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len([x for x in want.values() if x == 0]) > 300
    assert {x.doc_id: x.component_id for x in nc.near_copies(df).collect()} == want


def test_pairs_just_above_the_bound(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(1500):
        base = [f"p{i}w{k}" for k in range(229)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(base, {5 * p + 4 for p in r.sample(range(44), 5)}, i))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in nc.near_copies(df).collect()} == {i: i - i % 2 for i, _ in rows}


def test_parity_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)]))
        assert np.bitwise_count((nc.parity(a) ^ nc.parity(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_columns_of_any_name_are_kept(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, 5, "a", 7, 8, "r"), (2, text + " more", 6, "b", 7, 8, "s"), (3, "another text of its own", 6, "c", 7, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _t1 string, _t2 int, t1 int, row string")
    kept = nc.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
