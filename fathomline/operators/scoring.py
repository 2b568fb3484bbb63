"""Momentum, completeness and spotlight scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the weights, caps and windows that the scores are defined with
NEWS_WEIGHT, FUNDING_WEIGHT, HEADCOUNT_WEIGHT = 0.5, 0.35, 0.15
NEWS_SMOOTH, NEWS_CAP = 3.0, 4.0
FUNDING_TAU_DAYS = 180.0
RECENT_DAYS, BASE_NEAR_DAYS, BASE_FAR_DAYS, LOOKBACK_DAYS = 14, 21, 63, 70
HEADCOUNT_GAP_DAYS = 56
COMPLETENESS = {"website": 0.20, "description_short": 0.20, "funding": 0.15, "location": 0.10, "industry_group": 0.10, "people": 0.10, "logo_url": 0.05, "tags": 0.05, "employees": 0.05}
SPOTLIGHT_RECENCY, SPOTLIGHT_WINDOW_DAYS, SPOTLIGHT_LOG_DIVISOR = 3.0, 90, 3.0
SPOTLIGHT_NEWS, SPOTLIGHT_NEWS_CAP, SPOTLIGHT_FRESH = 0.5, 10, 1.5


def day(as_of: str) -> Column:
    return F.lit(as_of).cast("date")


def weekly_snapshots(events: DataFrame, key: str, when: str, as_of: str) -> DataFrame:
    """``(key, captured_week, news_count)`` for ISO-week Mondays that have an event."""
    week = F.date_trunc("week", when).cast("date")
    return events.where((F.col(when) <= day(as_of)) & (F.col(when) > F.date_sub(day(as_of), LOOKBACK_DAYS))).groupBy(key, week.alias("captured_week")).agg(F.count("*").alias("news_count"))


def news_windows(snapshots: DataFrame, key: str, as_of: str, scale: int = 1) -> DataFrame:
    """Mean counts of the recent window (floor excluded) and of the baseline (both ends included); ``scale`` widens the windows."""
    week, d = F.col("captured_week"), day(as_of)
    recent = (week > F.date_sub(d, RECENT_DAYS * scale)) & (week <= d)
    base = ~recent & week.between(F.date_sub(d, BASE_FAR_DAYS * scale), F.date_sub(d, BASE_NEAR_DAYS * scale))
    return snapshots.groupBy(key).agg(F.avg(F.when(recent, F.col("news_count"))).alias("recent"), F.avg(F.when(base, F.col("news_count"))).alias("baseline"))


def news_ratio(recent: Column, baseline: Column) -> Column:
    raw = (recent + NEWS_SMOOTH) / (baseline + NEWS_SMOOTH)
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(1 / NEWS_CAP)), F.lit(NEWS_CAP)))


def news_component(ratio: Column) -> Column:
    """Log scale: the cap scores 1, no change 0.5, its inverse 0."""
    return F.log(ratio * NEWS_CAP) / (2 * F.log(F.lit(NEWS_CAP)))


def funding_days(latest: Column, as_of: str) -> Column:
    return F.when(latest.isNotNull(), F.greatest(F.datediff(day(as_of), latest), F.lit(0)))


def funding_component(days: Column) -> Column:
    return F.exp(-days / FUNDING_TAU_DAYS)


def midpoint(low: Column, high: Column) -> Column:
    return (F.coalesce(low, high) + F.coalesce(high, low)) / 2


def headcount_midpoints(snapshots: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Most recent midpoint, and the oldest at least ``HEADCOUNT_GAP_DAYS`` before it."""
    dated = snapshots.withColumn("mid", midpoint(F.col(low), F.col(high))).where("mid is not null")
    recent = dated.groupBy(key).agg(F.max("captured_week").alias("at"), F.max_by("mid", "captured_week").alias("recent_mid"))
    older = dated.join(recent, key).where(F.col("captured_week") <= F.date_sub("at", HEADCOUNT_GAP_DAYS))
    base = older.groupBy(key).agg(F.min_by("mid", "captured_week").alias("base_mid"))
    return recent.join(base, key, "left").select(key, "recent_mid", "base_mid")


def headcount_growth(recent: Column, base: Column) -> Column:
    return F.when(base != 0, (recent - base) / base)


def headcount_component(growth: Column) -> Column:
    return F.when(growth.isNotNull(), F.least(F.greatest(0.5 + growth / 2, F.lit(0.0)), F.lit(1.0)))


def combine(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are present; null if none is."""
    top = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts])
    return F.when(weight > 0, top / weight)


def why(recent: Column, ratio: Column, days: Column, growth: Column, accelerated: float = 1.5, months_from: int = 90) -> Column:
    """Display chips of the present parts, by weight; rounding is half to even."""
    whole = lambda c: F.bround(c).cast("bigint").cast("string")
    news = F.when(recent.isNotNull() & (ratio >= accelerated), F.concat(F.lit("news +"), whole((ratio - 1) * 100), F.lit("%"))).when(recent.isNotNull() & ratio.isNotNull(), F.concat(whole(recent), F.lit(" news mentions")))
    weeks = whole(days / 7)
    raised = F.when(days < 7, "raised this week").when(days < months_from, F.concat(F.lit("raised "), weeks, F.when(weeks == "1", "wk ago").otherwise("wks ago"))).when(days.isNotNull(), F.concat(F.lit("raised "), whole(days / 30), F.lit("mo ago")))
    pct = F.bround(growth * 100)
    team = F.when(pct > 0, F.concat(F.lit("+"), whole(growth * 100), F.lit("% team"))).when(pct < 0, F.concat(whole(growth * 100), F.lit("% team")))
    return F.array_compact(F.array(news, raised, team))


def completeness(present: dict[str, Column]) -> Column:
    """Weighted share of present fields, to four places."""
    return F.round(reduce(lambda a, b: a + b, [F.when(present[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in COMPLETENESS.items() if k in present]), 4)


def spotlight(rounds: DataFrame, news: DataFrame, fresh: DataFrame, as_of: str) -> DataFrame:
    """``(company_id, score)`` over companies with a recent round, news or a fresh start.

    ``rounds(company_id, announced_date, amount_raised)``, ``news(company_id)`` and ``fresh(company_id)`` are already
    cut to their windows.
    """
    days = F.greatest(F.datediff(day(as_of), F.col("announced_date")), F.lit(0))
    recency = SPOTLIGHT_RECENCY * F.greatest(1 - days / F.lit(float(SPOTLIGHT_WINDOW_DAYS)), F.lit(0.0))
    bonus = F.when(F.col("amount_raised") > 0, F.log10(F.col("amount_raised").cast("double")) / SPOTLIGHT_LOG_DIVISOR).otherwise(0.0)
    funded = rounds.groupBy("company_id").agg(F.max(recency + bonus).alias("funding"), F.max("announced_date").alias("latest"))
    told = news.groupBy("company_id").agg(F.count("*").alias("articles"))
    out = funded.join(told, "company_id", "full").join(fresh.select("company_id", F.lit(True).alias("is_fresh")).distinct(), "company_id", "full")
    score = F.coalesce("funding", F.lit(0.0)) + SPOTLIGHT_NEWS * F.least(F.coalesce("articles", F.lit(0)), F.lit(SPOTLIGHT_NEWS_CAP)) + F.when(F.col("is_fresh"), SPOTLIGHT_FRESH).otherwise(0.0)
    return out.select("company_id", score.alias("score"), "latest")
