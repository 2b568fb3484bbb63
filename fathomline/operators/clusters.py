"""Themes and maps: k-means, projections and layouts a group.

Small groups are clustered in a task each; large ones by rounds over all their rows. Drivers replace the files of the groups that they computed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.grouped import per_key
from fathomline.operators.similarity import cosine
from fathomline.operators.similarity import unit as unit_vector
from fathomline.sources.landing import kept


def choose_k(n: int) -> int:
    return int(min(max(round((n / 2) ** 0.5), 2), 10))


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Labels of the best of several k-means++ starts, numbered by their first row."""
    best, labels = np.inf, np.zeros(len(x), int)
    for s in range(starts):
        rng = np.random.default_rng(seed + s)
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        if (cost := d.min(1).sum()) < best - 1e-12:
            best, labels = cost, own
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


LOCAL = 20_000  # rows of a group that one task clusters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _grouped(batches):
    """Group, ids, unit vectors and the groups' type for each group in each ``(grp, id, vector)`` batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        own, ids = coded.indices.to_numpy(), batch.column(1).to_numpy()
        x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        for n, g in enumerate(coded.dictionary.to_pylist()):
            mine = own == n
            yield g, ids[mine], x[mine], batch.schema.types[0]


def _table(kind: pa.DataType, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    first, *others = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(first, kind), *map(pa.array, others)], names)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each id, the same wherever a row is met."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, a start of centres at a time: rows x starts x centres."""
    starts, k, d = centres.shape
    across = (x @ centres.reshape(starts * k, d).T).reshape(len(x), starts, k)
    return np.maximum((x**2).sum(1)[:, None, None] - 2 * across + (centres**2).sum(2)[None], 0.0)


def _draw(centres: dict, starts: int, step: int, seed: int):
    """A task's best draw of the next centre for each group and start: the least exponential over squared distance."""

    def run(batches):
        best: dict = {}
        for g, ids, x, kind in _grouped(batches):
            if g not in centres:
                continue
            far = _far(x, centres[g]).min(2) if step else np.ones((len(x), starts))
            for s in range(starts):
                with np.errstate(divide="ignore"):
                    key = -np.log(_uniform(ids, (seed + s) * 1000 + step)) / far[:, s]
                n = int(np.lexsort((ids, key))[0])
                if (g, s) not in best or (key[n], ids[n]) < best[g, s][:2]:
                    best[g, s] = (float(key[n]), int(ids[n]), x[n].tolist())
        if best:
            yield _table(kind, [(g, s, *v) for (g, s), v in best.items()], ["grp", "start", "key", "id", "vector"])

    return run


def _gather(centres: dict):
    """A task's cost, counts and sums of each group's starts and centres."""

    def run(batches):
        held: dict = {}
        for g, _, x, kind in _grouped(batches):
            if g not in centres:
                continue
            far = _far(x, centres[g])
            own = far.argmin(2)
            starts, k, d = centres[g].shape
            out = held.setdefault(g, np.zeros((starts, k * (d + 1) + 1)))
            for s in range(starts):
                hot = np.zeros((len(x), k))
                hot[np.arange(len(x)), own[:, s]] = 1
                out[s] += np.concatenate([[far[np.arange(len(x)), s, own[:, s]].sum()], hot.sum(0), (hot.T @ x).ravel()])
        rows = [(g, s, values.tolist()) for g, table in held.items() for s, values in enumerate(table)]
        if rows:
            yield _table(kind, rows, ["grp", "start", "sums"])

    return run


def _added(batches):
    """The sums of each group and start, one row each, of the rows that tasks made."""
    held: dict = {}
    for batch in batches:
        kind = batch.schema.types[0]
        for g, s, values in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
            sums = values.values.to_numpy()
            held[g, s] = held[g, s] + sums if (g, s) in held else sums
    if held:
        yield _table(kind, [(g, s, v.tolist()) for (g, s), v in held.items()], ["grp", "start", "sums"])


def kmeans_over(rows: DataFrame, sizes: dict, starts: int = 10, rounds: int = 100, seed: int = 0, still: float = 1e-3) -> dict:
    """Centres of the best of several starts for each group of ``rows(grp, id, vector)``; ``sizes`` gives groups and their counts.

    Rows stay where they are: k-means++ draws a centre a round for all starts at once, and a round of k-means brings home sums and counts.
    The driver holds centres, starts times k for each group. A group's rounds end when no centre of unit vectors moves by more than ``still``.
    """
    kind = rows.schema["grp"].dataType.simpleString()
    ks = {g: min(choose_k(n), n) for g, n in sizes.items()}
    centres: dict = {g: None for g in sizes}
    for step in range(max(ks.values(), default=0)):
        open_ = {g: c for g, c in centres.items() if step < ks[g]}
        drawn = rows.mapInArrow(_draw(open_, starts, step, seed), f"grp {kind}, start long, key double, id long, vector array<double>")
        best = drawn.groupBy("grp", "start").agg(F.min(F.struct("key", "id", "vector")).alias("b")).select("grp", "start", "b.vector").collect()
        for g in open_:
            new = np.array([r.vector for r in sorted((r for r in best if r.grp == g), key=lambda r: r.start)])[:, None]
            centres[g] = new if centres[g] is None else np.concatenate([centres[g], new], axis=1)
    moving, costs = set(sizes), {}
    for _ in range(rounds):
        if not moving:
            break
        shape = f"grp {kind}, start long, sums array<double>"
        sums = rows.mapInArrow(_gather({g: centres[g] for g in moving}), shape).repartition("grp", "start").mapInArrow(_added, shape).toArrow()
        table: dict = {}
        for g, s, values in zip(*(sums.column(c).to_pylist() for c in range(2)), sums.column(2)):
            table.setdefault(g, {})[s] = values.values.to_numpy()
        for g, values in table.items():
            n, k, d = centres[g].shape
            flat = np.array([values[s] for s in range(n)])
            costs[g], counts = flat[:, 0], flat[:, 1 : k + 1]
            new = np.where(counts[:, :, None] > 0, flat[:, k + 1 :].reshape(n, k, d) / np.maximum(counts, 1)[:, :, None], centres[g])
            if np.abs(new - centres[g]).max() <= still:
                moving.discard(g)
            centres[g] = new
    return {g: c[int(np.argmin(costs[g]))] for g, c in centres.items()}


def _nearest(centres: dict):
    def run(batches):
        for g, ids, x, kind in _grouped(batches):
            if g in centres:
                label = _far(x, centres[g][None])[:, 0].argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(ids), kind), pa.array(ids), pa.array(label)], ["grp", "id", "theme"])

    return run


def themes(df: DataFrame, group: str, id_col: str, vector: str, smallest: int = 3, cluster=None, local: int = LOCAL) -> DataFrame:
    """``(group, id, theme)``: clusters of unit vectors in each group, numbered by their smallest id; those under ``smallest`` are dropped.

    Groups of up to ``local`` rows are clustered in a task each, by ``cluster(vectors, k)`` if given; larger ones by ``kmeans_over``.
    Rows of a null vector or id are left out.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    counts = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > local).collect()} if cluster is None else {}
    within = cluster or kmeans

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unit(np.stack(pdf.vector.to_numpy()).astype(float))
        pdf["theme"] = within(x, min(choose_k(len(x)), len(x)))
        return pdf[["grp", "id", "theme"]]

    kind = rows.schema["grp"].dataType.simpleString()
    small = rows
    for g in counts:
        small = small.where(~F.col("grp").eqNullSafe(F.lit(g)))
    out = small.groupBy("grp").applyInPandas(run, f"grp {kind}, id long, theme long")
    if counts:
        large = rows.where(reduce(lambda a, b: a | b, [F.col("grp").eqNullSafe(F.lit(g)) for g in counts]))
        large = kept(large, "vectors")
        out = out.unionByName(large.mapInArrow(_nearest(kmeans_over(large, counts)), f"grp {kind}, id long, theme long"))
    out = kept(out, "labels")
    sized = out.groupBy("grp", "theme").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    number = F.row_number().over(Window.partitionBy("grp").orderBy("low", "theme")) - 1
    sized = sized.select(F.col("grp").alias("g"), F.col("theme").alias("t"), "n", number.cast("long").alias("number")).where(F.col("n") >= smallest)
    named = out.join(sized, F.col("grp").eqNullSafe(F.col("g")) & (F.col("theme") == F.col("t")))
    return named.select(F.col("grp").alias(group), F.col("id").alias(id_col), F.col("number").alias("theme"))


def centroids(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``(keys, centre)``: the mean of each key's unit vectors, from sums of components."""
    unit = rows.select(*keys, F.posexplode(unit_vector(vector)).alias("place", "value"))
    means = unit.groupBy(*keys, "place").agg(F.avg("value").alias("value"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("centre"))  # as many as a vector's components


def named_themes(found: DataFrame, vectors: DataFrame, before: DataFrame | None, group: str, id_col: str, vector: str, least: float = 0.9) -> DataFrame:
    """``(group, slug, id, centre)`` of ``themes``: a theme keeps the slug of last time's most alike theme of its group, one to one, from ``least`` on.

    Another theme is named by its group and smallest id. ``before`` has ``group, slug, centre`` (other columns and repeated rows don't matter).
    """
    placed = found.join(vectors.select(group, id_col, vector), [group, id_col])
    now = centroids(placed, [group, "theme"], vector)
    smallest = found.groupBy(group, "theme").agg(F.min(id_col).alias("low"))
    now = now.join(smallest, [group, "theme"])
    fresh = F.concat(F.regexp_replace(F.lower(F.col(group).cast("string")), "[^a-z0-9]+", "-"), F.lit("-"), F.col("low"))
    if before is None:
        slugs = now.select(group, "theme", fresh.alias("slug"), "centre")
    else:
        last = before.select(F.col(group), "slug", F.col("centre").alias("last")).dropDuplicates([group, "slug"])
        pairs = now.join(last, group).select(F.col(group).alias("grp"), F.col("theme").cast("string").alias("theme"), F.col("slug").alias("old"), cosine(F.col("centre"), F.col("last")).alias("similarity"))
        kind = pairs.schema["grp"].dataType.simpleString()
        match = lambda rows: [(rows[0]["grp"], int(a), b) for a, b, _ in match_centroids([(r["theme"], r["old"], r["similarity"]) for r in rows], least)]
        kept_names = per_key(pairs, "grp", match, f"grp {kind}, theme long, old string")  # ten themes a group at most, so a hundred pairs
        slugs = now.join(kept_names.withColumnRenamed("grp", group), [group, "theme"], "left").select(group, "theme", F.coalesce("old", fresh).alias("slug"), "centre")
    return found.join(slugs, [group, "theme"]).select(group, "slug", id_col, "centre")


def replace_groups(df: DataFrame, place: str, group: str) -> None:
    """Write ``df`` so that each group it has replaces that group's files at ``place``, and groups it lacks stay as they are."""
    df.repartition(group).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(place)


def rebuild_themes(vectors: DataFrame, place: str, group: str, id_col: str, vector: str) -> DataFrame:
    """Themes of the groups in ``vectors`` in stead of those at ``place``, which keep their names where they are alike; the table at ``place``."""
    spark = vectors.sparkSession
    try:
        before = spark.read.parquet(place)
        before = kept(before.select(F.col(group).cast(vectors.schema[group].dataType), "slug", "centre").dropDuplicates([group, "slug"]), "themes")
    except AnalysisException:  # the first run
        before = None
    replace_groups(named_themes(themes(vectors, group, id_col, vector), vectors, before, group, id_col, vector), place, group)
    return spark.read.parquet(place)


def rebuild_map(vectors: DataFrame, place: str, group: str, id_col: str, vector: str) -> DataFrame:
    """Positions of the groups in ``vectors`` in stead of those at ``place``; the table at ``place``."""
    replace_groups(project(vectors, group, id_col, vector), place, group)
    return vectors.sparkSession.read.parquet(place)


def _moments(batches):
    """Of the ``(grp, vector)`` rows of a task: each group's count, sums and sums of products, one number a row."""
    held = {}
    schema = None
    for batch in batches:
        schema = schema or pa.schema([("grp", batch.schema.types[0]), ("place", pa.int32()), ("value", pa.float64())])
        groups = np.array(batch.column(0).to_pylist(), object)
        x = np.array(batch.column(1).to_pylist(), float).reshape(len(groups), -1)
        for g in set(groups.tolist()):
            mine = x[[v == g for v in groups]]
            new = np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
            held[g] = held[g] + new if g in held else new
    for g, values in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(values), schema.types[0]), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], schema=schema)


def main_axes(rows: DataFrame) -> DataFrame:
    """``(grp, mean, first, second)`` of ``rows(grp, vector)``: each group's two main axes, from sums that tasks make apart."""
    kind = rows.schema["grp"].dataType.simpleString()
    sums = rows.select("grp", "vector").mapInArrow(_moments, f"grp {kind}, place int, value double").groupBy("grp", "place").agg(F.sum("value").alias("value"))
    packed = sums.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("m"))  # as many as a vector's products

    def axes(values: pd.Series) -> pd.DataFrame:
        out = []
        for m in values:
            m = np.asarray(m, float)
            d = int((np.sqrt(4 * len(m) - 3) - 1) // 2)
            mean = m[1 : d + 1] / m[0]
            _, found = np.linalg.eigh(m[d + 1 :].reshape(d, d) / m[0] - np.outer(mean, mean))
            out.append((mean, found[:, -1], found[:, -2] if d > 1 else np.zeros(d)))
        return pd.DataFrame(out, columns=["mean", "first", "second"])

    kinds = "struct<mean: array<double>, first: array<double>, second: array<double>>"
    return packed.select("grp", F.pandas_udf(axes, kinds)(F.col("m")).alias("a")).select("grp", "a.*")


def project(df: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """``(group, id, x, y)``: the two main axes of each group's centred vectors, the largest loading positive, scaled to 0..1 (0.5 if constant).

    Only groups' moments and axes meet in one place, so a group may be of any size.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    placed = rows.join(main_axes(rows), "grp")
    centred = F.zip_with("vector", "mean", lambda a, b: a - b)
    along = lambda axis: F.aggregate(F.zip_with(centred, axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    placed = placed.select("grp", "id", along("first").alias("x"), along("second").alias("y"))
    ends = placed.groupBy("grp").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str):
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        span = F.nullif(high - low, F.lit(0.0))
        return F.when(high - low < 1e-9, 0.5).when(high >= -low, (F.col(c) - low) / span).otherwise((high - F.col(c)) / span)

    out = placed.join(ends, "grp").select("grp", "id", scaled("x").alias("x"), scaled("y").alias("y"))
    return out.withColumnsRenamed({"grp": group, "id": id_col})


def scale_axis(df: DataFrame, group: str, value: str, low: float, high: float, out: str) -> DataFrame:
    """``value`` scaled to [low, high] within its group; the middle if all are equal."""
    w = Window.partitionBy(group)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(b - a < 1e-9, (low + high) / 2).otherwise(low + (F.col(value) - a) / F.nullif(b - a, F.lit(0.0)) * (high - low)))


def match_centroids(pairs: list[tuple[str, str, float]], least: float = 0.9) -> list[tuple[str, str, float]]:
    """Greedy one-to-one matches by similarity; at most a few hundred clusters meet here."""
    left, right, out = set(), set(), []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s >= least and a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return out


def matched(pairs: DataFrame, left: str, right: str, score: str, least: float = 0.9) -> DataFrame:
    """One-to-one matches of ``pairs``, the most alike first; equally alike ones by name.

    Each round takes the pairs that are best for both their sides; as many rounds as a chain of better offers is long, a few here.
    """
    now, taken = pairs.where(F.col(score) >= least), None
    best = lambda side: Window.partitionBy(side).orderBy(F.desc(score), left, right)
    while True:
        ranked = now.withColumn("_l", F.row_number().over(best(left))).withColumn("_r", F.row_number().over(best(right)))
        found = ranked.where("_l = 1 and _r = 1").select(left, right, score)
        rows = found.collect()  # a row a cluster at most
        if not rows:
            return taken if taken is not None else found
        fixed = pairs.sparkSession.createDataFrame(rows, found.schema)
        taken = fixed if taken is None else taken.unionByName(fixed)
        now = now.join(F.broadcast(fixed.select(left)), left, "left_anti").join(F.broadcast(fixed.select(right)), right, "left_anti")
