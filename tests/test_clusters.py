import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fathomline.operators import clusters as C


def cost(x, labels):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in set(labels.tolist()))


def blobs(rng, n, d=6, k=5):
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] * 4 + rng.normal(size=(n, d))


def test_rounds_over_rows_cost_no_more_than_one_task(spark):
    rng = np.random.default_rng(1)
    data = {g: blobs(rng, 120 + 20 * g) for g in range(10)}
    rows = [(g, i, x.tolist()) for g, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "label int, vec_id long, v array<double>").repartition(5)
    for local, slack in ((10**6, 1e-9), (0, 0.01)):
        got = {g: {} for g in data}
        for r in C.themes(df, "label", "vec_id", "v", smallest=1, local=local).collect():
            got[r.label][r.vec_id] = r.theme
        mine = plain = 0.0
        for g, xs in data.items():
            labels = np.array([got[g][i] for i in range(len(xs))])
            unit = xs / np.linalg.norm(xs, axis=1, keepdims=True)
            mine, plain = mine + cost(xs, labels), plain + cost(xs, C.kmeans(unit, C.choose_k(len(xs))))
            first = [int(np.flatnonzero(labels == k)[0]) for k in sorted(set(labels.tolist()))]
            assert first == sorted(first) and sorted(set(labels.tolist())) == list(range(len(first)))
        assert mine <= plain * (1 + slack)


def test_a_group_of_many_vectors(spark, tmp_path):
    """Many rows of one group, of which no task holds more than its batches."""
    n, rng = 60_000, np.random.default_rng(2)
    flat = pa.array(blobs(rng, n, 8, 4).astype(np.float32).ravel())
    table = pa.table({"grp": pa.array(["a"] * n), "vec_id": np.arange(n), "v": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 8), flat)})
    pq.write_table(table, tmp_path / "v.parquet", row_group_size=10_000)
    df = spark.read.parquet(str(tmp_path / "v.parquet")).unionByName(spark.createDataFrame([(None, 1, [1.0, 0.0]), (None, 2, None)], "grp string, vec_id long, v array<float>"))
    got = C.themes(df, "grp", "vec_id", "v", smallest=1)
    counts = {(r.grp, r.theme): r.n for r in got.groupBy("grp", "theme").agg(F.count("*").alias("n")).collect()}
    assert sum(c for (g, _), c in counts.items() if g == "a") == n and counts[None, 0] == 1


def test_groups_are_replaced_and_names_stay(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = {"Big Data": blobs(rng, 40, 4, 3), "health": blobs(rng, 30, 4, 2)}
    frame = lambda data: spark.createDataFrame([(g, int(i), [float(v) for v in x]) for g, xs in data.items() for i, x in enumerate(xs)], "label string, vec_id long, v array<double>")
    place = f"file://{tmp_path}/themes"
    read = lambda df: {(r.label, r.vec_id): r.slug for r in df.collect()}
    one = read(C.rebuild_themes(frame(base), place, "label", "vec_id", "v"))
    assert {s.rsplit("-", 1)[0] for s in one.values()} == {"big-data", "health"}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "themes" / "label=health").glob("*.parquet")}
    again = {"Big Data": np.concatenate([rng.normal(size=(1, 4)), base["Big Data"] + rng.normal(size=(40, 4)) * 0.01])}  # ids move by one
    two = read(C.rebuild_themes(frame(again), place, "label", "vec_id", "v"))
    assert {k: v for k, v in two.items() if k[0] == "health"} == {k: v for k, v in one.items() if k[0] == "health"}
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "themes" / "label=health").glob("*.parquet")}
    kept = [one["Big Data", i] == two["Big Data", i + 1] for i in range(40) if ("Big Data", i) in one and ("Big Data", i + 1) in two]
    assert np.mean(kept) >= 0.8
    maps = f"file://{tmp_path}/maps"
    C.rebuild_map(frame(base), maps, "label", "vec_id", "v")
    got = C.rebuild_map(frame({"health": base["health"][:5]}), maps, "label", "vec_id", "v")
    assert {r.label: r.n for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"Big Data": 40, "health": 5}


def test_a_task_sends_a_row_for_each_group_and_start():
    x, centres = np.eye(4), {"a": np.stack([np.eye(4)[:2]] * 3)}
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 4), pa.array(range(4)), pa.array(x.tolist())], ["grp", "id", "vector"])
    sent = [row for out in C._gather(centres)([batch]) for row in out.to_pylist()]
    assert [(r["grp"], r["start"]) for r in sent] == [("a", 0), ("a", 1), ("a", 2)]
    (both,) = C._added([*C._gather(centres)([batch]), *C._gather(centres)([batch])])
    assert [r["sums"] for r in both.to_pylist()] == [[2 * v for v in r["sums"]] for r in sent]
