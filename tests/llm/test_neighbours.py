import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fathomline.llm import neighbours


def brute(rows, every, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in rows:
        if i % every == 0:
            q = np.array(v)
            s = sorted((-round(float(q @ np.array(w) / np.linalg.norm(q) / np.linalg.norm(w)), 12), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def made(spark, tmp_path):
    """50,000 vectors around 500 centres."""
    rng = np.random.default_rng(9)
    v = (rng.standard_normal((500, 64)) * 0.7)[rng.integers(0, 500, 50_000)] + rng.standard_normal((50_000, 64))
    flat = pa.array(v.astype(np.float32).ravel())
    table = pa.table({"vec_id": np.arange(50_000), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(50_001, dtype=np.int32) * 64), flat)})
    pq.write_table(table, tmp_path / "made.parquet")
    return spark.read.parquet(str(tmp_path / "made.parquet"))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", None])
def test_recall_through_spark(spark, sf, tmp_path):
    """The index reranks an eighth of a block at most, small tables included."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet") if sf else made(spark, tmp_path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = result(neighbours.nearest(df))
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = []
    for n in np.flatnonzero(ids % 50 == 0):
        score = v @ v[n]
        score[n] = -2
        best = np.argsort(-score)[:5]
        hits.append(len({i for i, _ in got[ids[n]]} & set(ids[best].tolist())) / 5)
        place = {i: k for k, i in enumerate(ids.tolist())}
        assert all(abs(score[place[i]] - s) < 1e-9 for i, s in got[ids[n]])
        assert got[ids[n]] == sorted(got[ids[n]], key=lambda x: (-x[1], x[0]))
    assert np.mean(hits) >= 0.9


def test_every_candidate_of_a_tiny_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 40")
    got = result(neighbours.nearest(df))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 50, 5)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_recall_against_brute_force():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(16000, 64))
    pivots = v[:256] / np.linalg.norm(v[:256], axis=1, keepdims=True)
    block = neighbours.Block(v, pivots)
    queries = v[rng.integers(0, 16000, 60)] + rng.normal(size=(60, 64)) * 0.5
    hit = []
    for q, (place, _) in zip(queries, block.search(queries, np.arange(16000), 5)):
        hit.append(len(set(place) & set(np.argsort(-neighbours.cosine(v, block.norms, q))[:5])) / 5)
    assert np.mean(hit) >= 0.9


def test_footrule_from_postings():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 8))
    block = neighbours.Block(v, v[:20], 7)
    near = block.nearest_pivots(v)
    rank = np.full((50, 20), 7)
    np.put_along_axis(rank, near, np.arange(7)[None], 1)
    for n in range(50):
        foot = np.abs(rank - rank[n]).sum(1)
        assert (7 * 8 - 2 * block.shared(near[n]) == foot).all()


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]),
            (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [1.0, 0.0]), (101, [1.0, 0.0]), (102, [1.0, 0.0]), (103, [1.0, 0.0]), (104, [0.0, 1.0]), (None, [1.0, 1.0]), (150, [0.3, -1.0]), (8, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = result(neighbours.nearest(df))
    want = brute([r for r in rows if r[1] and len(r[1]) == 2], 50, 5)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0
