"""Exports: CSV, RSS, Markdown, sitemap shards and the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.names import format_usd
from fathomline.functions.text import rfc822, xml_escape
from fathomline.operators.windows import shard

SHARD = 40_000


def export_rows(companies: DataFrame, links: DataFrame, investors: DataFrame) -> DataFrame:
    """One row a company: distinct investor names joined by comma, amounts rounded."""
    names = links.join(investors.select(F.col("id").alias("investor_id"), F.col("name").alias("investor")), "investor_id")
    names = names.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("investor")), ", ").alias("investors"))
    out = companies.join(names, F.col("id") == F.col("company_id"), "left")
    return out.select("slug", "name", "industry_group", F.round("total_raised_usd").cast("bigint").alias("total_raised"), F.coalesce("investors", F.lit("")).alias("investors"))


def write_csv(df: DataFrame, path: str, order: str = "slug") -> None:
    """Quoted fields, doubled quotes, a header in each file; range-partitioned, so files follow each other in order."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def rss_item(title: Column, link: Column, day: Column, text: Column) -> Column:
    date = F.when(day.isNotNull(), F.concat(F.lit("<pubDate>"), rfc822(day.cast("timestamp")), F.lit("</pubDate>"))).otherwise("")
    return F.concat(F.lit("<item><title>"), xml_escape(title), F.lit("</title><link>"), xml_escape(link), F.lit("</link>"), date, F.lit("<description>"), xml_escape(text), F.lit("</description></item>"))


def rss_feed(items: DataFrame, title: str, link: str, size: int = 50) -> DataFrame:
    """One row: the feed of the newest ``size`` items ``(title, link, day, text)``."""
    newest = items.orderBy(F.desc_nulls_last("day"), "link").limit(size)
    lines = newest.select(F.struct(F.col("day"), F.col("link"), rss_item(F.col("title"), F.col("link"), F.col("day"), F.col("text")).alias("item")).alias("s"))
    body = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("s"))), lambda s: s["item"]), "\n")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), xml_escape(F.lit(title)), F.lit("</title><link>"), xml_escape(F.lit(link)), F.lit("</link>"))
    return lines.agg(body.alias("body")).select(F.concat(head, "body", F.lit("</channel></rss>")).alias("xml"))


def markdown(companies: DataFrame, rounds: DataFrame) -> DataFrame:
    """``(slug, md)``: a page an entity, with its rounds newest first."""
    lines = rounds.groupBy(F.col("company_id").alias("id")).agg(
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("announced_date", "id", F.concat_ws(" · ", F.coalesce(F.col("announced_date").cast("string"), F.lit("undated")), F.coalesce("round_type", F.lit("round")), format_usd(F.col("amount_raised"))).alias("line"))))), lambda s: F.concat(F.lit("- "), s["line"])), "\n").alias("lines"))
    out = companies.join(lines, "id", "left")
    return out.select("slug", F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.coalesce("description_short", F.lit("")), F.lit("## Rounds"), F.coalesce("lines", F.lit("none"))).alias("md"))


def write_sitemap(df: DataFrame, path: str, base: str, size: int = SHARD) -> None:
    """URL lists in shards of ``size`` by slug order."""
    rows = shard(df.select("slug"), "slug", size).select(F.concat(F.lit(base), "slug").alias("value"), "shard")
    rows.repartition("shard").sortWithinPartitions("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


def append_run(df: DataFrame, path: str) -> None:
    """Add ledger rows ``(stage, started_at, status, inputs_seen, rows_written, error, summary)``."""
    bad = ~F.col("status").isin("success", "empty", "error")
    df.where(F.assert_true(~bad, "unknown status").isNull()).write.mode("append").parquet(path)


def run_status(rows: int, error: str | None) -> str:
    return "error" if error else "success" if rows else "empty"


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small report as a Markdown table; ``limit`` bounds what comes to the driver."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
