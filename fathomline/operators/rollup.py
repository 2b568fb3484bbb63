"""Quarterly roll-ups, growth windows, de-duplicated sums and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarter(c) -> Column:
    return F.date_trunc("quarter", c).cast("date")


def quarter_shift(as_of: str, n: int) -> Column:
    """First day of the quarter ``n`` quarters from that of ``as_of``."""
    return F.add_months(F.trunc(F.lit(as_of).cast("date"), "quarter"), 3 * n)


def funding_by_quarter(rounds: DataFrame, as_of: str, quarters: int = 8) -> DataFrame:
    """Sum and count of each of the trailing quarters, the current one included."""
    kept = rounds.where(F.col("announced_date").isNotNull() & (F.col("announced_date") >= quarter_shift(as_of, 1 - quarters)) & (F.col("announced_date") <= F.lit(as_of).cast("date")))
    return kept.groupBy(quarter("announced_date").alias("quarter")).agg(F.sum("amount_raised").alias("total"), F.count("*").alias("rounds"))


def fill_quarters(totals: DataFrame, as_of: str, quarters: int = 8) -> DataFrame:
    """A row for each quarter of the window; missing ones are zero."""
    spine = totals.sparkSession.range(1).select(F.explode(F.sequence(quarter_shift(as_of, 1 - quarters), quarter_shift(as_of, 0), F.expr("interval 3 months"))).alias("quarter"))
    out = spine.join(totals, "quarter", "left")
    return out.select("quarter", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


def growth(recent: Column, prior: Column) -> Column:
    """(recent - prior) / prior; null unless prior is positive."""
    return F.when(prior > 0, (recent - prior) / prior)


def two_windows(rounds: DataFrame, key: str, as_of: str) -> DataFrame:
    """Per key: sums and counts of the last two whole quarters and of the two before.

    A sum without rows is null, a count zero; the running quarter counts for neither.
    """
    lo, mid, hi = (quarter_shift(as_of, n) for n in (-4, -2, 0))
    d = F.col("announced_date")
    recent, prior = (d >= mid) & (d < hi), (d >= lo) & (d < mid)
    return rounds.where((d >= lo) & (d < hi)).groupBy(key).agg(
        F.sum(F.when(recent, F.col("amount_raised"))).alias("recent_total"), F.sum(F.when(prior, F.col("amount_raised"))).alias("prior_total"),
        F.count_if(recent).alias("recent_rounds"), F.count_if(prior).alias("prior_rounds"))


def deduplicated_total(rounds: DataFrame, key: str) -> DataFrame:
    """Sum over distinct (type, amount) of each key."""
    return rounds.where("amount_raised is not null").select(key, "round_type", "amount_raised").distinct().groupBy(key).agg(F.sum("amount_raised").alias("total"))


def percent(n: Column, d: Column) -> Column:
    """n of d in percent to one decimal, half to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(n * 100.0, d), 1), F.lit(0.0))


def staleness(c: str, as_of: str) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), F.col(c))
    return F.when(F.col(c).isNull(), "never").when(age < 30, "<30d").when(age <= 90, "30-90d").otherwise(">90d")


def slot_scores(df: DataFrame, expected: str, got: str, keys: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 of array columns as sets; empty denominators score 1."""
    tp = F.sum(F.size(F.array_intersect(expected, got)))
    fp = F.sum(F.size(F.array_except(got, expected)))
    fn = F.sum(F.size(F.array_except(expected, got)))
    sums = df.groupBy(*(keys or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / F.nullif(b, F.lit(0)))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))
