"""Reusable predicates and filter builders; each returns a Column or filters a DataFrame."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_excluded() -> Column:
    return F.col("exclusion_reason").isNull()


def shown() -> Column:
    """The catalog bar: not excluded, and described or funded."""
    return not_excluded() & (F.col("description_short").isNotNull() | (F.col("funding_round_count") > 0))


def sanitize_term(term: str) -> str:
    """A search term without pattern and list punctuation, spaces squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"[,()%*\\]", " ", term)).strip()


def sanitized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[,()%*\\]", " "), r"\s+", " "))


def matches_any(columns: list[str], term: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    pattern = f"%{sanitize_term(term)}%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def any_pattern(column: str, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).ilike(p) for p in patterns])


def employee_overlap(low: int | None, high: int | None) -> Column:
    """Head-count ranges that overlap [low, high]."""
    cond = F.lit(True)
    if low is not None:
        cond &= F.col("employee_count_max") >= low
    if high is not None:
        cond &= F.col("employee_count_min") <= high
    return cond


def within_days(column: str, days: int, as_of: str) -> Column:
    return F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days)


def stale(column: str, days: int, as_of: str) -> Column:
    """Never checked, or longer ago than ``days``."""
    return F.col(column).isNull() | (F.col(column) < F.date_sub(F.lit(as_of).cast("date"), days))


def outdated(column: str, current: str) -> Column:
    """A version stamp that is missing or behind, by text order."""
    return F.col(column).isNull() | (F.col(column) < current)


def filter_companies(df: DataFrame, **options) -> DataFrame:
    """Apply each given option's filter; None and empty options do nothing.

    Options: q, industry, country, status, tag, emp_min, emp_max, funded_since_days (with as_of),
    min_total, has_website, created_since, exclude_slugs.
    """
    given = {k: v for k, v in options.items() if v not in (None, "", [])}
    conds: list[Column] = []
    if "q" in given:
        conds.append(matches_any(["name", "description_short"], given["q"]))
    if "industry" in given:
        conds.append(F.col("industry_group") == given["industry"])
    if "country" in given:
        conds.append(F.col("hq_country") == given["country"])
    if "status" in given:
        conds.append(F.coalesce("status", F.lit("active")) == given["status"])
    if "tag" in given:
        conds.append(F.array_contains("tags", given["tag"]))
    conds.append(employee_overlap(given.get("emp_min"), given.get("emp_max")))
    if given.get("funded_since_days", 0) > 0:
        conds.append(within_days("latest_round_date", given["funded_since_days"], given["as_of"]))
    if "min_total" in given:
        conds.append(F.col("total_raised_usd") >= given["min_total"])
    if given.get("has_website"):
        conds.append(F.col("website").isNotNull())
    if "created_since" in given:
        conds.append(F.col("created_at") >= F.lit(date.fromisoformat(given["created_since"])))
    if "exclude_slugs" in given:
        conds.append(~F.col("slug").isin(given["exclude_slugs"]))
    return reduce(lambda d, c: d.where(c), conds, df)


META_LEAK = r"(?i)should be dropped|should be excluded|not a (real )?competitor"


def leaks_meta(column: str = "reasoning") -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(META_LEAK)
