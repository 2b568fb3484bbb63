"""Upserts, merges and remaps as derivations of new table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.names import disambiguated
from fathomline.sources.landing import dropped, kept


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``old`` with ``new`` by key: new non-null values win, others stay; of several new rows the last by ``order``."""
    latest = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")
    values = [c for c in old.columns if c not in keys]
    joined = old.join(latest.select(*keys, *[F.col(c).alias(f"_{c}") for c in values]), keys, "full")
    return joined.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Parents that have new children lose their old ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def sticky_links(links: DataFrame, keys: list[str], flag: str = "is_lead") -> DataFrame:
    """One row a key; a flag once set stays set."""
    return links.groupBy(*keys).agg(F.bool_or(flag).alias(flag))


def unique_slugs(df: DataFrame, base: str, id_col: str) -> DataFrame:
    """``slug``: the base for its first id, the base with a hash of the id for the others."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(id_col))
    return df.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") == 1, F.col(base)).otherwise(disambiguated(F.col(base), F.col(id_col)))).drop("_n")


def resolve_remap(remap: DataFrame, loser: str = "loser", survivor: str = "survivor", rounds: int = 20) -> DataFrame:
    """Each loser's final survivor: chains are halved each round (pointer doubling) until none moves.

    A chain of 2**rounds is resolved; a cycle raises.
    """
    now = remap.select(F.col(loser).alias("loser"), F.col(survivor).alias("survivor")).where("loser <> survivor")
    for step in range(rounds):
        ahead = now.select(F.col("loser").alias("survivor"), F.col("survivor").alias("next"))
        new = now.join(ahead, "survivor", "left").select("loser", F.coalesce("next", "survivor").alias("survivor"), F.col("next").isNotNull().alias("moved"))
        new = kept(new, "remap")
        if step:
            dropped(now)
        moved, round_trips = new.agg(F.count_if("moved"), F.count_if(F.col("loser") == F.col("survivor"))).first()
        if round_trips:
            raise ValueError("the remap has a cycle")
        now = new.drop("moved")
        if not moved:
            return now
    raise ValueError("the remap has a longer chain than allowed")


def remapped(df: DataFrame, remap: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` led to its survivor; ``remap`` has one row a loser."""
    m = remap.select(F.col("loser").alias("_loser"), F.col("survivor").alias("_survivor"))
    return df.join(m, F.col(column) == F.col("_loser"), "left").withColumn(column, F.coalesce("_survivor", column)).drop("_loser", "_survivor")


def merge_entities(entities: DataFrame, remap: DataFrame, fill: list[str], id_col: str = "id") -> DataFrame:
    """Survivors with null columns filled from their losers, the smallest loser id first."""
    m = remap.select(F.col("loser").alias(id_col), "survivor")
    losers = entities.join(m, id_col)
    # ignorenulls by a filter: min_by over the rows that have a value
    gifts = losers.groupBy("survivor").agg(*[F.expr(f"min_by({c}, {id_col}) filter (where {c} is not null)").alias(f"_{c}") for c in fill])
    kept = entities.join(m.select(id_col), id_col, "left_anti").join(gifts.withColumnRenamed("survivor", id_col), id_col, "left")
    return kept.withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).drop(*[f"_{c}" for c in fill])


def exactly_one(df: DataFrame) -> DataFrame:
    """``df``, or an error at run time unless it has one row."""
    n = df.limit(2).agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("_n") == 1, "not exactly one row").isNull()).drop("_n")
