"""Exports and incremental stages in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import windows as W
from fathomline.plans.aggregates import day, D
from fathomline.plans.registry import q
from fathomline.plans.relational import NEWS, news
from fathomline.sources import sinks as K

Q = f"date_trunc('quarter', {D})"
q("S33_export_rows", lambda t: K.export_rows(t.companies, t.company_links, t.investors), "select slug, c.name, industry_group, cast(round(total_raised_usd) as bigint) as total_raised, coalesce(n.names, '') as investors from companies c left join (select company_id, array_to_string(list_sort(list(distinct i.name)), ', ') as names from company_links join investors i on investor_id = i.id group by 1) n on company_id = c.id")
q("S34_rss_feed", lambda t: K.rss_feed(news(t).select("title", F.col("url").alias("link"), F.col("published_date").alias("day"), F.col("title").alias("text")), "News", "https://x.example.com", 20).select(F.length("xml").alias("n"), F.size(F.regexp_extract_all("xml", F.lit("<item>"), F.lit(0))).alias("items")))
q("S35_markdown", lambda t: K.markdown(t.companies, t.rounds).select("slug", F.length("md").alias("n"), F.regexp_count("md", F.lit("\n- ")).alias("rounds")))
q("S36_sitemap_shards", lambda t: W.shard(t.companies.select("slug"), "slug", 500).groupBy("shard").agg(F.count("*").alias("n"), F.min("slug").alias("first")), "select shard, count(*) as n, min(slug) as first from (select slug, (row_number() over (order by slug) - 1) // 500 as shard from companies) group by 1")
q("S37_run_ledger", lambda t: t.runs.select("id", "stage", F.when(F.col("status") == "error", "error").when(F.col("rows_written") > 0, "success").otherwise("empty").alias("outcome")), "select id, stage, case when status = 'error' then 'error' when rows_written > 0 then 'success' else 'empty' end as outcome from runs")
q("S30_first_source", lambda t: t.companies.select("id", F.coalesce("employee_count_max", F.when(F.col("id") % 2 == 0, F.col("id") % 90), F.lit(1)).alias("staff")), "select id, coalesce(employee_count_max, case when id % 2 = 0 then id % 90 end, 1) as staff from companies")
q("X1_first_in_lookback", lambda t: W.first_per(news(t).where(F.col("published_date") >= F.date_sub(day(), 60)), ["url"], [F.asc("published_date"), F.asc("id")]).select("url", "id"), f"with {NEWS} select url, id from (select *, row_number() over (partition by url order by published_date, id) as n from news where published_date >= {D} - 60) where n = 1")
q("X2_title_duplicates", lambda t: W.first_per(news(t).withColumn("key", F.lower(F.trim("title"))), ["company_id", "key"], [F.asc("id")]).select("id"), f"with {NEWS} select min(id) as id from news group by company_id, lower(trim(title))")
q("X3_weekly_windows", lambda t: t.runs.groupBy("stage", F.window("started_at", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select("stage", F.col("w.start").cast("date").alias("week"), "n"), "select stage, cast(date_trunc('week', started_at) as date) as week, count(*) as n from runs group by 1, 2")
q("X4_session_windows", lambda t: t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
  "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events), s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g), c as (select user_id, k, count(*) as n from s group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from c group by 1")
q("X5_unprocessed", lambda t: news(t).join(t.rounds.where("id % 3 = 0").select(F.col("news_url").alias("url")).distinct(), "url", "left_anti").select("id"), f"with {NEWS} select id from news where url not in (select news_url from rounds where id % 3 = 0 and news_url is not null)")
q("Z2_website_worklist", lambda t: t.companies.where("website is not null and (checked_at is null or checked_at < date '2001-07-01')").join(t.rounds.select(F.col("company_id").alias("id")).distinct(), "id", "left_anti").select("id"), "select id from companies where website is not null and (checked_at is null or checked_at < date '2001-07-01') and id not in (select company_id from rounds)")
q("Z10_thin_text", lambda t: t.raw("documents").where("length(text) < 500").join(t.companies.select(F.col("id").alias("doc_id"), "total_raised_usd"), "doc_id").orderBy(F.desc_nulls_last("total_raised_usd"), "doc_id").limit(60).select("doc_id"), "select doc_id from documents join companies c on c.id = doc_id where length(text) < 500 order by total_raised_usd desc nulls last, doc_id limit 60")
q("Z21_slug_list", lambda t: t.competitors.groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 3").join(t.shown.select("id", "slug"), "id").select("slug"), "select slug from shown s join (select company_id from competitors group by 1 having count(*) >= 3) on company_id = s.id")
q("Z17_inspected", lambda t: t.companies.where("slug = 'co-12'").join(t.rounds.groupBy("company_id").agg(F.count("*").alias("n"), F.max("announced_date").alias("last"), F.sum("amount_raised").cast("double").alias("total")), F.expr("id = company_id"), "left").select("slug", "n", "last", "total"), "select slug, n, last, total from companies c left join (select company_id, count(*) as n, max(announced_date) as last, cast(sum(amount_raised) as double) as total from rounds group by 1) on company_id = c.id where slug = 'co-12'")
q("Z22_point_lookup", lambda t: t.companies.where("slug = 'co-77'").select("slug", "name", "industry_group"), "select slug, name, industry_group from companies where slug = 'co-77'")
q("Z23_trend_rank", lambda t: t.rounds.join(t.companies.select(F.col("id").alias("company_id"), "hq_country"), "company_id").where(F.col("announced_date").isNotNull()).groupBy("hq_country").agg(F.sum(F.when(F.col("announced_date") >= "2000-01-01", F.col("amount_raised"))).cast("double").alias("recent"), F.sum(F.when(F.col("announced_date") < "2000-01-01", F.col("amount_raised"))).cast("double").alias("prior")).withColumn("growth", F.round((F.col("recent") - F.col("prior")) / F.nullif("prior", F.lit(0.0)), 6)).orderBy(F.desc_nulls_last("growth"), F.desc("recent")).limit(8).select("hq_country", "growth"),
  "select hq_country, round((recent - prior) / nullif(prior, 0), 6) as growth from (select hq_country, cast(sum(amount_raised) filter (announced_date >= date '2000-01-01') as double) as recent, cast(sum(amount_raised) filter (announced_date < date '2000-01-01') as double) as prior from rounds join companies c on company_id = c.id where announced_date is not null group by 1) order by 2 desc nulls last, recent desc limit 8")
q("L9_theme_order", lambda t: t.raw("embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")).orderBy(F.desc("n"), "label").limit(5), "select label, count(*) as n, min(vec_id) as first from embeddings group by 1 order by n desc, label limit 5")
q("L20_newest_members", lambda t: t.shown.where("industry_group = 'FURNITURE'").orderBy(F.desc("created_at"), "name").limit(5).select("id", "created_at"), "select id, created_at from shown where industry_group = 'FURNITURE' order by created_at desc, name limit 5")
q("L18_merged_top_k", lambda t: t.rounds.where("amount_raised is not null").orderBy(F.desc("amount_raised"), "id").limit(40).select("id", F.col("amount_raised").cast("double").alias("w"), F.lit("round").alias("kind")).unionByName(t.companies.where("total_raised_usd is not null").orderBy(F.desc("total_raised_usd"), "id").limit(40).select("id", F.col("total_raised_usd").cast("double").alias("w"), F.lit("total").alias("kind"))).orderBy(F.desc("w"), "kind", "id").limit(50),
  "select * from ((select id, cast(amount_raised as double) as w, 'round' as kind from rounds where amount_raised is not null order by amount_raised desc, id limit 40) union all (select id, cast(total_raised_usd as double), 'total' from companies where total_raised_usd is not null order by total_raised_usd desc, id limit 40)) order by w desc, kind, id limit 50")
q("H61_quarter_spine", lambda t: t.spark.range(1).select(F.explode(F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2001-07-01").cast("date"), F.expr("interval 3 months"))).alias("quarter")), "select cast(x as date) as quarter from range(timestamp '2000-01-01', timestamp '2001-07-02', interval 3 months) r(x)")
q("H69_sources_deduped", lambda t: W.first_per(news(t).withColumn("host", F.regexp_extract("url", "//([^/]+)", 1)), ["source", "host"], [F.asc("id")]).select("source", "host", "id"), f"with {NEWS} select source, regexp_extract(url, '//([^/]+)', 1) as host, min(id) as id from news group by 1, 2")
q("H68_moves_by_person", lambda t: t.links.where("is_lead").join(t.rounds.select(F.col("id").alias("round_id"), "company_id", "announced_date"), "round_id").groupBy("investor_id", "company_id").agg(F.min("announced_date").alias("first")).groupBy("investor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("first").isNull().alias("undated"), "first", "company_id"))), lambda s: s["company_id"].cast("string")), ">").alias("moves")),
  "select investor_id, string_agg(cast(company_id as varchar), '>' order by first is null, first, company_id) as moves from (select investor_id, company_id, min(announced_date) as first from links join rounds r on round_id = r.id where is_lead group by 1, 2) group by 1")
