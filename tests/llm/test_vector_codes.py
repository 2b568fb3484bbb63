import hashlib
from collections import defaultdict
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from fathomline.llm import vector_codes as vc


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in Python integers, row by row."""
    kept = [(i, [floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and x == x and abs(x) != inf for x in v)]
    out = []
    for length in {len(v) for _, v, _ in kept}:
        own = [r for r in kept if len(r[1]) == length]
        at = vc.cuts(length, parts)
        cut = lambda v: [v[a:b] for a, b in zip(at, at[1:])]
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        pick = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
        for _ in range(rounds):
            for p in range(parts):
                met = defaultdict(list)
                for _, v, _ in own:
                    met[pick(cut(v)[p], books[p])].append(cut(v)[p])
                for e, xs in met.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in own:
            codes = [pick(x, books[p]) for p, x in enumerate(cut(v))]
            out.append([i, "".join(f"{c:02x}" for c in codes), sum(far(x, books[p][codes[p]]) for p, x in enumerate(cut(v))), label, sha])
    sums = defaultdict(int)
    for _, _, error, label, _ in out:
        sums[label] += error
    fit = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fit(e), fit(sums[label]), s) for i, c, e, label, s in out), key=repr)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted(map(tuple, vc.compress(df).collect()), key=repr)


def test_ties_nulls_lengths_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 16).astype(float).tolist(), i % 3 or None) for i in range(60)]  # few values: many ties
    rows += [(7, [1.0] * 16, None), (None, [0.5] * 16, 1), (None, [0.5] * 16, 1), (100, None, 1), (101, [nan] * 16, 1), (102, [None] * 16, 1), (103, [inf] + [0.0] * 15, 1)]
    rows += [(200 + i, [float(i)] * 11, 5) for i in range(4)] + [(300, [], 5), (301, [2.0], None)]
    assert run(spark, rows) == plain(rows)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(0, 30, 8)).tolist(), 1) for i in range(30)]
    assert run(spark, rows, "double") == plain(rows)
    rows = [(i, (rng.standard_normal(8) * 1e6).tolist(), i % 2) for i in range(40)]
    assert run(spark, rows, "double") == plain(rows)
    rows = [(1, [1.7e308] * 8, 1), (2, [-1.7e308] * 8, 1), (3, [0.0] * 8, 2)]
    assert run(spark, rows, "double") == plain(rows)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3, "a", "b", 9)], "vec_id long, embedding array<float>, label int, code string, total string, length int")
    assert vc.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.compress(df).count() == 1 and vc.compress(df.limit(0)).collect() == []


@pytest.mark.parametrize("top", [50, 3000, 1 << 22, 1 << 27])
def test_screening_is_rigorous(top):
    rng = np.random.default_rng(top)
    x = rng.integers(-top, top + 1, (500, 8))
    entries = np.concatenate([x[:6] + rng.integers(-1, 2, (6, 8)), x[:6], rng.integers(-top, top + 1, (4, 8))])
    exact = np.array([[int(((a - b).astype(object) ** 2).sum()) for b in entries] for a in x], object)
    low, high = vc.intervals(x, entries)
    own = (x.astype(object) ** 2).sum(axis=1)
    true = exact - own[:, None]
    assert all(Fraction(lo) <= t <= Fraction(hi) for lo, t, hi in zip(low.ravel(), true.ravel(), high.ravel()))
    found, distance = vc.nearest(x, entries)
    assert [min(range(16), key=row.__getitem__) for row in exact] == found.tolist()
    assert exact[np.arange(500), found].tolist() == distance.tolist()


def test_hot_label(spark):
    rows = [(i, [float(i % 5), 1.0], 0 if i % 3 else i) for i in range(400)]
    assert run(spark, rows) == plain(rows)
