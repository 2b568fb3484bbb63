"""Aggregations: roll-ups, histograms, distinct counts and censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import rollup as R
from fathomline.operators import windows as W
from fathomline.plans.registry import q
from fathomline.plans.relational import LEGS, NEWS, news, portfolio
from fathomline.sources.tables import AS_OF


def day():
    return F.lit(AS_OF).cast("date")


D = f"date '{AS_OF}'"
Q = f"date_trunc('quarter', {D})"


def dbl(*cols):
    return [F.col(c).cast("double").alias(c) for c in cols]


def shown_rounds(t):
    return t.rounds.join(t.shown.select(F.col("id").alias("company_id"), "industry_group"), "company_id")


A1 = f"select cast(date_trunc('quarter', announced_date) as date) as quarter, cast(sum(amount_raised) as double) as total, count(*) as rounds from rounds join shown on company_id = shown.id where announced_date >= {Q} - interval 21 months and announced_date <= {D} group by 1"
q("A1_funding_by_quarter", lambda t: R.funding_by_quarter(shown_rounds(t), AS_OF).select("quarter", *dbl("total"), "rounds"), A1)
TWO = f"select industry_group, cast(sum(amount_raised) filter (announced_date >= {Q} - interval 6 months) as double) as recent_total, cast(sum(amount_raised) filter (announced_date < {Q} - interval 6 months) as double) as prior_total, count(*) filter (announced_date >= {Q} - interval 6 months) as recent_rounds, count(*) filter (announced_date < {Q} - interval 6 months) as prior_rounds from rounds join shown on company_id = shown.id where announced_date >= {Q} - interval 12 months and announced_date < {Q} group by 1"
q("A2_two_window_momentum", lambda t: R.two_windows(shown_rounds(t), "industry_group", AS_OF).select("industry_group", *dbl("recent_total", "prior_total"), "recent_rounds", "prior_rounds"), TWO)


def sparse(t):
    return R.funding_by_quarter(t.rounds.where("company_id = 7"), AS_OF, 20)


SPARSE = f"select cast(date_trunc('quarter', announced_date) as date) as quarter, sum(amount_raised) as total, count(*) as rounds from rounds where company_id = 7 and announced_date >= {Q} - interval 57 months and announced_date <= {D} group by 1"
q("A3_quarters_filled", lambda t: R.fill_quarters(sparse(t), AS_OF, 20).select("quarter", *dbl("total"), "rounds"),
  f"select cast(x as date) as quarter, cast(coalesce(total, 0) as double) as total, coalesce(rounds, 0) as rounds from range({Q} - interval 57 months, {Q} + interval 1 day, interval 3 months) r(x) left join ({SPARSE}) s on s.quarter = cast(x as date)")
q("A4_totals_filled", lambda t: R.fill_quarters(R.funding_by_quarter(t.rounds, AS_OF, 8), AS_OF, 8).select("quarter", *dbl("total")),
  f"select cast(x as date) as quarter, cast(coalesce((select sum(amount_raised) from rounds where cast(date_trunc('quarter', announced_date) as date) = cast(x as date) and announced_date <= {D}), 0) as double) as total from range({Q} - interval 21 months, {Q} + interval 1 day, interval 3 months) r(x)")
q("A5_growth", lambda t: R.two_windows(shown_rounds(t), "industry_group", AS_OF).select("industry_group", F.round(R.growth(F.col("recent_total").cast("double"), F.col("prior_total").cast("double")), 6).alias("growth")),
  f"select industry_group, case when prior_total > 0 then round((recent_total - prior_total) / prior_total, 6) end as growth from ({TWO})")
q("A6_window_metrics", lambda t: R.two_windows(t.rounds, "company_id", AS_OF).select("company_id", *dbl("recent_total", "prior_total"), F.bround(R.growth(F.col("recent_total").cast("double"), F.col("prior_total").cast("double")), 4).alias("growth")),
  f"select company_id, recent_total, prior_total, case when prior_total > 0 then round_even((recent_total - prior_total) / prior_total, 4) end as growth from ({TWO.replace('industry_group', 'company_id').replace(' join shown on company_id = shown.id', '')})")
DEDUP = "select company_id, sum(amount_raised) as total from (select distinct company_id, round_type, amount_raised from rounds where amount_raised is not null) group by 1"
q("A7_deduplicated_total", lambda t: R.deduplicated_total(t.rounds, "company_id").select("company_id", *dbl("total")), f"select company_id, cast(total as double) as total from ({DEDUP})")
q("A8_stated_or_computed", lambda t: t.companies.join(R.deduplicated_total(t.rounds, "company_id"), F.col("id") == F.col("company_id"), "left").select("id", F.greatest("total_raised_usd", "total").cast("double").alias("raised"), (F.col("total_raised_usd") >= F.coalesce("total", F.lit(0))).alias("stated")),
  f"select id, cast(greatest(total_raised_usd, total) as double) as raised, total_raised_usd >= coalesce(total, 0) as stated from companies left join ({DEDUP}) on id = company_id")
q("A9_having_alphabetic", lambda t: t.shown.where("industry_group is not null").groupBy("industry_group").count().where("count >= 3").orderBy("industry_group").select("industry_group", F.col("count").alias("n")), "select industry_group, count(*) as n from shown where industry_group is not null group by 1 having count(*) >= 3 order by 1")
q("A10_distinct_sorted", lambda t: t.companies.select("status").distinct().orderBy("status"), "select distinct status from companies order by 1")
q("A11_top_and_rest", lambda t: (lambda c: c.orderBy(F.desc("n"), "hq_country").limit(6).crossJoin(F.broadcast(c.agg(F.count("*").alias("kinds")))).select("hq_country", "n", (F.col("kinds") - 6).alias("rest")))(t.shown.groupBy("hq_country").agg(F.count("*").alias("n"))),
  "with c as (select hq_country, count(*) as n from shown group by 1) select hq_country, n, (select count(*) from c) - 6 as rest from c order by n desc, hq_country limit 6")
q("A12_ranked_counts", lambda t: t.shown.groupBy("industry_group").agg(F.count("*").alias("n")).where("n >= 3 and industry_group is not null").orderBy(F.desc("n"), "industry_group"), "select industry_group, count(*) as n from shown where industry_group is not null group by 1 having count(*) >= 3")
q("A13_having_eight", lambda t: t.companies.where("employee_count_min is not null").groupBy("hq_country", "industry_group").agg(F.count("*").alias("n")).where("n >= 8"), "select hq_country, industry_group, count(*) as n from companies where employee_count_min is not null group by 1, 2 having count(*) >= 8")


def tags():
    return F.array(F.concat(F.lit("t"), F.col("id") % 9), F.concat(F.lit("t"), F.col("id") % 5), F.lower("industry_group"))


q("A14_unnest_distinct", lambda t: t.companies.select(F.explode(F.array_distinct(tags())).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).where("n >= 3"),
  "select tag, count(*) as n from (select unnest(list_distinct(list_value(concat('t', id % 9), concat('t', id % 5), lower(industry_group)))) as tag from companies) where tag is not null group by 1 having count(*) >= 3")
q("A15_distinct_values", lambda t: t.companies.select("hq_country").distinct().orderBy("hq_country"), "select distinct hq_country from companies order by 1")
q("A16_exact_counts", lambda t: t.shown.agg(F.count("*").alias("companies")).crossJoin(t.investors.agg(F.count("*").alias("investors"))), "select (select count(*) from shown) as companies, (select count(*) from investors) as investors")
q("A17_dual_counts", lambda t: t.shown.agg(F.count_if(F.col("created_at") >= F.date_sub(day(), 7)).alias("week"), F.count_if(F.col("created_at") >= F.date_sub(day(), 30)).alias("month")), f"select count(*) filter (created_at >= {D} - 7) as week, count(*) filter (created_at >= {D} - 30) as month from shown")
q("A18_coverage", lambda t: t.shown.agg(F.count("*").alias("n"), F.count_if(F.col("funding_round_count") > 0).alias("funded"), F.max("checked_at").alias("checked")), "select count(*) as n, count(*) filter (funding_round_count > 0) as funded, max(checked_at) as checked from shown")
q("A19_portfolio_mean", lambda t: (lambda d, r: d.union(r).distinct().join(t.companies.where("total_raised_usd is not null"), F.expr("company_id = id")).groupBy("investor_id").agg(F.round(F.avg(F.col("total_raised_usd").cast("double")), 4).alias("mean"), F.count_if(F.col("total_raised_usd") > 500000).alias("large")))(*portfolio(t)),
  f"with {LEGS} select investor_id, round(avg(cast(total_raised_usd as double)), 4) as mean, count(*) filter (total_raised_usd > 500000) as large from legs join companies on company_id = id where total_raised_usd is not null group by 1")
q("A20_distinct_over_union", lambda t: (lambda d, r: t.investors.join(d.union(r).distinct().groupBy("investor_id").agg(F.count("*").alias("n")), F.expr("id = investor_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")))(*portfolio(t)),
  f"with {LEGS} select id, coalesce(n, 0) as n from investors left join (select investor_id, count(*) as n from legs group by 1) on id = investor_id")
q("A21_latest_round_columns", lambda t: t.companies.join(W.first_per(t.rounds, ["company_id"], [F.desc_nulls_last("announced_date"), F.desc("id")]).select("company_id", "announced_date", "round_type", F.col("amount_raised").cast("double").alias("amount")), F.expr("id = company_id"), "left").select("id", "announced_date", "round_type", "amount"),
  "select c.id, announced_date, round_type, amount from companies c left join (select *, cast(amount_raised as double) as amount, row_number() over (partition by company_id order by announced_date desc nulls last, id desc) as n from rounds) r on company_id = c.id and n = 1")
q("A22_round_counts", lambda t: t.counted.select("id", "funding_round_count"), "select id, funding_round_count from counted")
SIGNALS = {"the": r"(?i)\bthe\b", "digits": r"[0-9]{3,}", "mail": r"[a-z0-9.]+@[a-z0-9.]+", "bars": r"\|", "shout": r"[A-Z]{5,}"}
q("A23_regex_census", lambda t: t.raw("documents").groupBy("source").agg(*[F.max(F.col("text").rlike(p)).cast("int").alias(k) for k, p in SIGNALS.items()]).agg(F.count("*").alias("sources"), *[F.sum(k).cast("bigint").alias(k) for k in SIGNALS]),
  "select count(*) as sources, " + ", ".join(f"cast(sum({k}) as bigint) as {k}" for k in SIGNALS) + " from (select source, " + ", ".join(f"max(cast(regexp_matches(text, '{p}') as int)) as {k}" for k, p in SIGNALS.items()) + " from documents group by 1)")
FIELDS = ["website", "description_short", "industry_group", "logo_url", "employee_count_min", "status"]
q("A24_completeness_census", lambda t: t.companies.where("exclusion_reason is null").agg(F.count("*").alias("n"), *[R.percent(F.count(c), F.count("*")).alias(c) for c in FIELDS]),
  "select count(*) as n, " + ", ".join(f"round_even(count({c}) * 100.0 / count(*), 1) as {c}" for c in FIELDS) + " from companies where exclusion_reason is null")
q("A24_duplicate_groups", lambda t: t.companies.groupBy("website").agg(F.count("*").alias("n")).where("n > 1 and website is not null"), "select website, count(*) as n from companies where website is not null group by 1 having count(*) > 1")
q("A24_staleness", lambda t: t.companies.groupBy(R.staleness("checked_at", AS_OF).alias("bucket")).agg(F.count("*").alias("n")),
  f"select case when checked_at is null then 'never' when {D} - checked_at < 30 then '<30d' when {D} - checked_at <= 90 then '30-90d' else '>90d' end as bucket, count(*) as n from companies group by 1")


def near_pairs(t):
    r = t.rounds.where("amount_raised is not null")
    a, b = r.alias("a"), r.alias("b")
    x, y = F.expr("cast(a.amount_raised as double)"), F.expr("cast(b.amount_raised as double)")
    near = (F.greatest(x, y) - F.least(x, y)) / F.greatest(x, y) <= 0.15
    return a.join(b, F.expr("a.company_id = b.company_id and a.id < b.id")).where(near & F.expr("abs(datediff(a.announced_date, b.announced_date)) <= 60")).select(F.expr("a.id as first_id"), F.expr("b.id as second_id"))


NEAR = "select a.id as first_id, b.id as second_id from rounds a join rounds b on a.company_id = b.company_id and a.id < b.id where a.amount_raised is not null and b.amount_raised is not null and abs(a.announced_date - b.announced_date) <= 60 and (greatest(cast(a.amount_raised as double), cast(b.amount_raised as double)) - least(cast(a.amount_raised as double), cast(b.amount_raised as double))) / greatest(cast(a.amount_raised as double), cast(b.amount_raised as double)) <= 0.15"
q("A25_near_duplicates", near_pairs, NEAR)
q("A26_kind_by_bucket", lambda t: t.rounds.withColumn("bucket", F.when(F.col("news_url").isNull(), "none").when(F.col("id") % 2 == 0, "stored").otherwise("refetch")).groupBy("confidence").pivot("bucket", ["none", "stored", "refetch"]).count().na.fill(0),
  "select confidence, count(*) filter (news_url is null) as none, count(*) filter (news_url is not null and id % 2 = 0) as stored, count(*) filter (news_url is not null and id % 2 <> 0) as refetch from rounds group by 1")
q("A27_verdicts", lambda t: t.runs.groupBy("status").agg(F.count("*").alias("n")), "select status, count(*) as n from runs group by 1")
q("A28_eligible_groups", lambda t: t.companies.where("exclusion_reason is null").groupBy("industry_group").agg(F.count("*").alias("n")).where("n >= 8"), "select industry_group, count(*) as n from companies where exclusion_reason is null group by 1 having count(*) >= 8")
q("A29_max_gate", lambda t: t.runs.groupBy("stage").agg(F.max("started_at").alias("last")).select("stage", (F.col("last") < F.expr("timestamp '2024-01-25 00:00:00'")).alias("due")), "select stage, max(started_at) < timestamp '2024-01-25 00:00:00' as due from runs group by 1")
q("A30_value_rewrite", lambda t: (lambda m: t.companies.join(F.broadcast(m), "industry_group", "left").select("id", F.coalesce("canon", "industry_group").alias("industry_group")))(t.spark.createDataFrame([("MACHINERY", "Machines"), ("BUILDING", "Construction")], "industry_group string, canon string")),
  "select id, case industry_group when 'MACHINERY' then 'Machines' when 'BUILDING' then 'Construction' else industry_group end as industry_group from companies")
q("A31_max_amount", lambda t: t.rounds.groupBy("company_id").agg(F.max("amount_raised").cast("double").alias("top")), "select company_id, cast(max(amount_raised) as double) as top from rounds group by 1")
q("A33_day_buckets", lambda t: t.companies.groupBy(F.col("created_at").alias("day")).agg(F.count("*").alias("companies")).join(t.rounds.groupBy(F.col("announced_date").alias("day")).agg(F.count("*").alias("rounds")), "day", "full").where("day is not null").select("day", F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("rounds", F.lit(0)).alias("rounds")),
  "select day, coalesce(companies, 0) as companies, coalesce(rounds, 0) as rounds from (select created_at as day, count(*) as companies from companies group by 1) full join (select announced_date as day, count(*) as rounds from rounds where announced_date is not null group by 1) using (day)")
q("A34_case_merge", lambda t: t.investors.withColumn("shout", F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.col("name"))).withColumn("key", F.lower(F.trim(F.substring("name", 1, 17)))).groupBy("key").agg(F.min_by("shout", "id").alias("name"), F.bool_or(F.col("kind") == "angel").alias("angel"), F.expr("min_by(slug, id) filter (where id % 3 <> 0)").alias("site")),
  "select lower(trim(substring(name, 1, 17))) as key, arg_min(case when id % 2 = 0 then upper(name) else name end, id) as name, bool_or(kind = 'angel') as angel, arg_min(slug, id) filter (id % 3 <> 0) as site from investors group by 1")
q("A35_latest_run", lambda t: W.first_per(t.runs, ["stage"], [F.desc("started_at"), F.desc("id")]).select("stage", "id", "status"), "select stage, id, status from (select *, row_number() over (partition by stage order by started_at desc, id desc) as n from runs) where n = 1")


def slots(t):
    e, g = F.expr("filter(array('a', 'b', 'c', 'd'), (x, i) -> (doc_id + i) % 3 <> 0)"), F.expr("filter(array('a', 'b', 'c', 'e'), (x, i) -> (doc_id + i) % 4 <> 0)")
    return t.raw("documents").select("lang", e.alias("expected"), g.alias("got"))


SLOTS = "select lang, list_filter(['a', 'b', 'c', 'd'], lambda x, i: (doc_id + i - 1) % 3 <> 0) as e, list_filter(['a', 'b', 'c', 'e'], lambda x, i: (doc_id + i - 1) % 4 <> 0) as g from documents"
q("A36_slot_scores", lambda t: R.slot_scores(slots(t), "expected", "got", ["lang"]).select("lang", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]),
  f"with s as (select lang, sum(len(list_intersect(e, g))) as tp, sum(len(g)) as ng, sum(len(e)) as ne from ({SLOTS}) group by 1) select lang, round(tp / ng, 9) as precision, round(tp / ne, 9) as recall, round(2 * (tp / ng) * (tp / ne) / (tp / ng + tp / ne), 9) as f1 from s")
q("A37_accuracy", lambda t: t.raw("labels").agg(F.coalesce(F.avg((F.col("quality") == 1).cast("double")), F.lit(1.0)).alias("accuracy")), "select coalesce(avg(case when quality = 1 then 1.0 else 0.0 end), 1.0) as accuracy from labels")
q("A38_floors", lambda t: t.raw("documents").join(t.raw("labels"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("value")).select("lang", (F.floor(F.col("value") * 1000) / 1000).alias("floor"), (F.col("value") >= 0.5).alias("holds")),
  "select lang, floor(avg(quality) * 1000) / 1000 as floor, avg(quality) >= 0.5 as holds from documents join labels using (doc_id) group by 1")
q("H13_percent", lambda t: t.runs.groupBy("stage").agg(R.percent(F.count_if(F.col("status") == "error"), F.count("*")).alias("pct")), "select stage, round_even(count(*) filter (status = 'error') * 100.0 / count(*), 1) as pct from runs group by 1")
q("H12_round_text", lambda t: news(t).where("round_id is not null").groupBy("round_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda s: s["title"]), ". ").alias("text")),
  f"with {NEWS} select round_id, string_agg(title, '. ' order by id) as text from news where round_id is not null group by 1")
q("Z4_page_concat", lambda t: t.raw("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n\n").alias("text")),
  "select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by 1")
q("Z16_adapter_floor", lambda t: t.raw("documents").groupBy("source").agg(F.count("*").alias("n")).select("source", "n", (F.col("n") < F.when(F.col("source") == "src1", 100).otherwise(40)).alias("low")), "select source, count(*) as n, count(*) < case when source = 'src1' then 100 else 40 end as low from documents group by 1")
q("Z14_grouped_in_order", lambda t: t.raw("documents").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids")), "select source, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents group by 1")
