import re

import numpy as np
import xxhash

from fathomline.llm import simhash


def brute_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=3):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(got, docs):
    fps = {i: brute_fp(t) for i, t in docs}
    want = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (7, "One"), (8, "one"), (1, "É a\x0bb c"), (2, "x " * 5000), (4, "X " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    check(got, rows)
    twice = simhash.near_duplicates(df.union(df)).collect()
    assert len(twice) == 2 * len(rows)
    nobody = simhash.near_duplicates(spark.createDataFrame([(None, "lone words here")], "doc_id long, text string")).collect()
    assert nobody[0].component_id is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_crowded_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    points = {base}
    while len(points) < 300:
        x = base
        for b in rng.integers(0, 63, rng.integers(1, 6)):
            x ^= 1 << int(b)
        points.add(x)
    points |= {int(x) for x in rng.integers(1 << 62, size=100)}
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    from fathomline.llm.common import components

    for crowd in (2, 8, 4096):
        found = {r.node: r.root for r in components(simhash.links(df, crowd=crowd)).collect()}
        want = brute_components({p: p for p in points})
        assert {p: found.get(p, p) for p in points} == want


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    low = np.bitwise_count(simhash.bit_counts(a) ^ simhash.bit_counts(b))
    assert (low <= np.bitwise_count(a ^ b)).all()
