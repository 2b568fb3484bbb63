"""What the training-data operators share: tables, shared folders, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        folder = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def refuse_clashes(names: list[str]) -> None:
    """A result must not hold two columns of one name."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"two columns named {', '.join(twice)}")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Delete the files that ``settle`` wrote for ``df``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def look_up(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], ways: int = 64) -> DataFrame:
    """``many`` with the columns of ``one``, which holds each key once; keys without a row there get nulls, null keys meet null keys.

    A key may hold most rows of ``many``: its rows are dealt ``ways`` ways by the columns of ``spread``, and only the
    distinct pairs of key and way meet ``one`` before the rows meet those pairs.
    """
    values = [c for c in one.columns if c not in keys]
    many = many.withColumn("_way", F.pmod(F.xxhash64(*spread), F.lit(ways)))
    own = many.select(*keys, "_way").distinct()
    found = own.join(one.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)], *values), _same(keys, "_o"), "left")
    found = found.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(keys)], F.col("_way").alias("_met"), *values)
    return many.join(found, _same(keys, "_m") & (F.col("_way") == F.col("_met")), "left").drop("_way", "_met", *[f"_m{i}" for i in range(len(keys))])


def _same(keys: list[str], prefix: str):
    met = F.lit(True)
    for i, c in enumerate(keys):
        met &= F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return met


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for each node on an edge, ``root`` its component's smallest node.
    Only minima are aggregated (with map-side partial sums), never neighbour lists; a hub's
    rows meet in ordinary equi-joins, which adaptive execution may split. Each round is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    now = settle(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = settle(
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct(),
            "links",
        )
        found = tuple(
            new.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        discard(now)
        now = new
        if found == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found
