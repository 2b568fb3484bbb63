"""Latest rows, survivors, gaps and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order; partial limits run before the exchange."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def at_maximum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All rows that hold their key's maximum; ties stay."""
    ranked = df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))))
    return ranked.where("_rank = 1").drop("_rank")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    return page.orderBy(F.asc(key)).limit(size)


def runner_up_gap(df: DataFrame, keys: list[str], score: str, tiebreak: str) -> DataFrame:
    """The best row of each key with ``gap`` to the second-best score (null if alone)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tiebreak))
    out = df.withColumn("gap", F.col(score) - F.lead(score).over(order)).withColumn("_n", F.row_number().over(order))
    return out.where("_n = 1").drop("_n")


def shard(df: DataFrame, key: str, size: int) -> DataFrame:
    """Shards of ``size`` rows by key order, numbered without one global sort task.

    Rows are range-partitioned; each range's offset is the running sum of the counts before it.
    """
    ranged = df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(key))).persist()  # both uses must see the same ranges
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    out = ranged.join(offsets, "_range").withColumn("shard", F.floor((F.col("_before") + F.col("_n") - 1) / size))
    return out.drop("_range", "_n", "_before")


def complete(df: DataFrame, expected: int) -> DataFrame:
    """``df`` if it has ``expected`` rows, else no row: a scan that broke off counts as failed."""
    whole = df.agg((F.count("*") == expected).alias("_whole"))
    return df.join(F.broadcast(whole.where("_whole")), how="cross").drop("_whole")
