"""Edges and walks over companies and investors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def also_backed_by(links: DataFrame, company: int, degree_cap: int, k: int = 8) -> DataFrame:
    """Companies that share investors with ``company``, through investors of at most ``degree_cap`` link rows.

    ``links(investor_id, company_id)`` keeps a row for each path; degree counts rows, sharing counts investors.
    """
    own = links.where(F.col("company_id") == company).select("investor_id").distinct()
    near = links.join(own, "investor_id", "left_semi")  # the walk starts from one company: filter before counting
    low = near.groupBy("investor_id").agg(F.count("*").alias("degree")).where(F.col("degree") <= degree_cap)
    shared = near.join(low, "investor_id").where(F.col("company_id") != company)
    return shared.groupBy("company_id").agg(F.countDistinct("investor_id").alias("shared")).orderBy(F.desc("shared"), "company_id").limit(k)


def co_investors(links: DataFrame, investor: int, k: int = 8) -> DataFrame:
    """Investors on the same rounds as ``investor``, by distinct rounds."""
    own = links.where(F.col("investor_id") == investor).select("round_id").distinct()
    both = links.join(own, "round_id", "left_semi").where(F.col("investor_id") != investor)
    return both.groupBy("investor_id").agg(F.countDistinct("round_id").alias("rounds")).orderBy(F.desc("rounds"), "investor_id").limit(k)


def similar_edges(companies: DataFrame, k: int = 8) -> DataFrame:
    """Up to ``k`` edges a company to others of its industry that share tags.

    ``companies(id, industry_group, tags)``. Score is shared tags over the union; ties go to more shared tags, then to the smaller id.
    Companies of one industry and tag set are one class: classes meet on (industry, tag), a class gives its ``k + 1`` smallest ids, and
    all companies of a class share one list of candidates. So no pairs of companies are made.
    """
    sets = companies.where("industry_group is not null and size(tags) > 0").select("id", "industry_group", F.array_sort(F.array_distinct("tags")).alias("set"))
    smallest = Window.partitionBy("industry_group", "set").orderBy("id")
    heads = sets.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1).drop("_n")
    tags = sets.select("industry_group", "set").distinct().withColumn("tag", F.explode("set"))
    met = tags.join(tags.withColumnRenamed("set", "other"), ["industry_group", "tag"]).groupBy("industry_group", "set", "other").agg(F.count("*").alias("shared"))
    scored = met.withColumn("score", F.round(F.col("shared") / (F.size("set") + F.size("other") - F.col("shared")), 3))
    listed = scored.join(heads.select(F.col("id").alias("related_id"), "industry_group", F.col("set").alias("other")), ["industry_group", "other"])
    best = [F.desc("score"), F.desc("shared"), F.asc("related_id")]
    listed = listed.withColumn("_n", F.row_number().over(Window.partitionBy("industry_group", "set").orderBy(*best))).where(F.col("_n") <= k + 1)
    mine = sets.join(listed.select("industry_group", "set", "related_id", "score", "shared"), ["industry_group", "set"]).where("id <> related_id")
    return mine.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*best))).where(F.col("_n") <= k).select("id", "related_id", "score", "shared")


def competitor_edges(competitors: DataFrame) -> DataFrame:
    """One edge a pair from the best rank, scored by its inverse."""
    best = competitors.where("competitor_company_id is not null").groupBy("company_id", "competitor_company_id").agg(F.min("rank").alias("rank"))
    return best.select("company_id", "competitor_company_id", F.round(1 / F.col("rank"), 3).alias("score"))
