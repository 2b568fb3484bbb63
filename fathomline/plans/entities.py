"""Merges, round repair, timelines and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import names as N
from fathomline.operators import clusters as C
from fathomline.operators import resolve as M
from fathomline.operators import rounds as R
from fathomline.operators import timeline as L
from fathomline.operators import windows as W
from fathomline.plans.aggregates import day, D
from fathomline.operators.dedup import MOST_JUDGED, dedup_companies, domain_remap, judged_remap, name_pairs
from fathomline.plans.registry import q
from fathomline.plans.relational import NEWS, news
from fathomline.sources.landing import new_place

TYPES = "case when id % 11 = 0 then null when id % 7 = 0 then 'Series A extension' when id % 5 = 0 then 'Series ?' else concat('Series ', case id % 3 when 0 then 'A' when 1 then 'B' else 'C' end) end"


def typed(t):
    """Rounds with amounts and types that coincide often."""
    return t.rounds.withColumn("round_type", F.expr(TYPES)).withColumn("amount_raised", F.expr("cast(case when id % 13 = 0 then null else (company_id % 7 + id % 4 + 1) * 1000000 end as decimal(20,2))"))


TYPED = f"typed as (select id, company_id, announced_date, confidence, news_url, valuation, {TYPES} as round_type, cast(case when id % 13 = 0 then null else (company_id % 7 + id % 4 + 1) * 1000000 end as decimal(20,2)) as amount_raised from rounds)"
KIND = "case when {0} is null or {0} = 'Series ?' then null when {0} = 'Series A extension' then 'series a' else lower({0}) end"

# upserts
q("M1_upsert", lambda t: M.upsert(t.companies.select("id", "website", "logo_url"), t.companies.select((F.col("id") + 100).alias("id")).select("id", F.expr("case when id % 2 = 0 then concat('https://new/', id) end").alias("website"), F.lit(None).cast("string").alias("logo_url")), ["id"], F.col("id")).select("id", "website", "logo_url"),
  "select coalesce(o.id, n.id) as id, coalesce(n.website, o.website) as website, coalesce(n.logo_url, o.logo_url) as logo_url from companies o full join (select id, case when id % 2 = 0 then concat('https://new/', id) end as website, cast(null as varchar) as logo_url from (select id + 100 as id from companies)) n on o.id = n.id")
q("M2_replace_children", lambda t: M.replace_children(t.competitors.select("company_id", "rank", "competitor_name"), t.competitors.where("company_id % 4 = 0 and rank = 1").select("company_id", "rank", F.lit("New").alias("competitor_name")), "company_id"),
  "select company_id, rank, competitor_name from competitors where company_id not in (select company_id from competitors where company_id % 4 = 0 and rank = 1) union all select company_id, rank, 'New' from competitors where company_id % 4 = 0 and rank = 1")
q("M4_unique_slugs", lambda t: M.unique_slugs(t.raw("part").select(F.col("p_partkey").alias("id"), N.slugify(F.col("p_name")).alias("base")), "base", "id").select("id", "slug"),
  "select id, case when n = 1 then base else base || '-' || substring(sha256(cast(id as varchar)), 1, 6) end as slug from (select p_partkey as id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as base, row_number() over (partition by trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') order by p_partkey) as n from part)")
q("M9_sticky_links", lambda t: M.sticky_links(t.links, ["round_id", "investor_id"]), "select round_id, investor_id, bool_or(is_lead) as is_lead from links group by 1, 2")


def remap(t):
    """Chains of losers: 2 to 1 to 0, 5 to 4 to 3, and so on."""
    return t.companies.where("id % 3 <> 0").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("survivor"))


ROOTS = "roots as (select id as loser, id - id % 3 as survivor from companies where id % 3 <> 0)"
q("M10_resolved_remap", lambda t: M.resolve_remap(remap(t)), f"with {ROOTS} select * from roots")
q("M10_merge_companies", lambda t: M.merge_entities(t.companies.select("id", "website", "description_short", "total_raised_usd"), M.resolve_remap(remap(t)), ["website", "description_short", "total_raised_usd"]).select("id", "website", "description_short", F.col("total_raised_usd").cast("double").alias("total")),
  f"with {ROOTS}, g as (select survivor, arg_min(website, id) filter (website is not null) as w, arg_min(description_short, id) filter (description_short is not null) as d, arg_min(total_raised_usd, id) filter (total_raised_usd is not null) as r from companies join roots on id = loser group by 1) select id, coalesce(website, w) as website, coalesce(description_short, d) as description_short, cast(coalesce(total_raised_usd, r) as double) as total from companies left join g on id = survivor where id not in (select loser from roots)")
q("M10_repointed_children", lambda t: M.remapped(t.rounds.select("id", "company_id"), M.resolve_remap(remap(t)), "company_id"), f"with {ROOTS} select id, coalesce(survivor, company_id) as company_id from rounds left join roots on company_id = loser")
q("M10_competitors_without_self", lambda t: (lambda m: W.first_per(M.remapped(M.remapped(t.competitors.where("competitor_company_id is not null").select("company_id", "competitor_company_id", "rank"), m, "company_id"), m, "competitor_company_id").where("company_id <> competitor_company_id"), ["company_id", "competitor_company_id"], [F.asc("rank")]))(M.resolve_remap(remap(t))),
  f"with {ROOTS}, r as (select coalesce(a.survivor, company_id) as company_id, coalesce(b.survivor, competitor_company_id) as competitor_company_id, rank from competitors left join roots a on company_id = a.loser left join roots b on competitor_company_id = b.loser where competitor_company_id is not null) select company_id, competitor_company_id, min(rank) as rank from r where company_id <> competitor_company_id group by 1, 2")
q("M11_merge_investors", lambda t: M.sticky_links(M.remapped(t.links, t.investors.where("id % 2 = 0").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("survivor")), "investor_id"), ["round_id", "investor_id"]),
  "select round_id, investor_id - case when investor_id % 2 = 0 then 1 else 0 end as investor_id, bool_or(is_lead) as is_lead from links group by 1, 2")
q("M12_domain_clusters", lambda t: (lambda c: c.join(c.groupBy("website").agg(F.min(F.struct(F.col("description_short").isNull().alias("d"), "created_at", "id"))["id"].alias("survivor"), F.count("*").alias("n")).where("n > 1"), "website").where("id <> survivor").select(F.col("id").alias("loser"), "survivor"))(t.companies.where("website is not null")),
  "select id as loser, survivor from (select id, first_value(id) over (partition by website order by description_short is null, created_at, id) as survivor from companies where website is not null) where id <> survivor")
q("M14_purge_with_children", lambda t: t.links.join(t.investors.where("kind = 'unknown'").select(F.col("id").alias("investor_id")), "investor_id", "left_anti").groupBy("investor_id").agg(F.count("*").alias("n")), "select investor_id, count(*) as n from links where investor_id not in (select id from investors where kind = 'unknown') group by 1")
q("M15_classified", lambda t: t.investors.select("id", F.when(F.col("id").isin(3, 6, 9), "institutional").when(F.col("kind") == "unknown", "angel").otherwise(F.col("kind")).alias("kind")), "select id, case when id in (3, 6, 9) then 'institutional' when kind = 'unknown' then 'angel' else kind end as kind from investors")
q("M16_no_signal", lambda t: t.rounds.where("amount_raised is not null or announced_date is not null or round_type is not null").select("id"), "select id from rounds where amount_raised is not null or announced_date is not null or round_type is not null")
CLUSTER = f"with {TYPED}, k as (select *, {KIND.format('round_type')} as kind from typed where amount_raised is not null), c as (select *, coalesce(kind, case when min(kind) over g = max(kind) over g then min(kind) over g end, '') as cluster from k window g as (partition by company_id, amount_raised))"
q("M17_amount_clusters", lambda t: R.amount_clusters(typed(t)).select("id", "cluster"), CLUSTER + " select id, cluster from c")
q("M17_collapsed", lambda t: R.collapse_amounts(typed(t)), CLUSTER + ", s as (select id as loser, first_value(id) over (partition by company_id, amount_raised, cluster order by kind is not null desc, announced_date is not null desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, news_url is not null desc, id) as survivor from c) select * from s where loser <> survivor")
q("M18_near_amounts", lambda t: R.collapse_near_amounts(t.rounds, t.links))
q("M19_equal_valuations", lambda t: W.first_per(t.rounds.where("valuation is not null"), ["company_id", "valuation"], [F.desc(F.col("amount_raised").isNotNull()), F.asc("id")]).select("id"), "select id from (select *, row_number() over (partition by company_id, valuation order by amount_raised is not null desc, id) as n from rounds where valuation is not null) where n = 1")
q("M21_phantom_valuations", lambda t: t.rounds.where("amount_raised is null and round_type is null and valuation is not null").alias("p").join(t.rounds.where("amount_raised is not null").alias("f"), F.expr("p.company_id = f.company_id and p.valuation = f.valuation"), "left_anti").select("id"), "select id from rounds p where amount_raised is null and round_type is null and valuation is not null and not exists (select 1 from rounds f where f.company_id = p.company_id and f.valuation = p.valuation and amount_raised is not null)")
q("M22_folded", lambda t: R.fold_losers(typed(t), R.collapse_amounts(typed(t)), ["announced_date", "news_url"]).select("id", "announced_date", "news_url"),
  CLUSTER + ", s as (select id as loser, first_value(id) over (partition by company_id, amount_raised, cluster order by kind is not null desc, announced_date is not null desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, news_url is not null desc, id) as survivor from c), m as (select * from s where loser <> survivor), g as (select survivor, arg_min(announced_date, o) filter (announced_date is not null) as d, arg_min(news_url, o) filter (news_url is not null) as u from (select t.*, survivor, (2 - case confidence when 'high' then 2 when 'medium' then 1 else 0 end) * 10000000000 + id as o from typed t join m on id = loser) group by 1) select id, coalesce(announced_date, d) as announced_date, coalesce(news_url, u) as news_url from typed left join g on id = survivor where id not in (select loser from m)")
q("M5_reconciled", lambda t: R.reconcile(t.rounds))
q("M7_amount_match", lambda t: typed(t).alias("a").join(typed(t).alias("b"), F.expr("a.company_id = b.company_id and a.amount_raised = b.amount_raised and a.id > b.id")).where(N.compatible_types(F.col("a.round_type"), F.col("b.round_type"))).groupBy(F.expr("a.id as id")).agg(F.expr("min(b.id)").alias("found")),
  f"with {TYPED}, k as (select *, {KIND.format('round_type')} as kind from typed where amount_raised is not null) select a.id, min(b.id) as found from k a join k b on a.company_id = b.company_id and a.amount_raised = b.amount_raised and a.id > b.id where a.kind is null or b.kind is null or a.kind = b.kind group by 1")
q("M23_repointed_links", lambda t: M.sticky_links(M.remapped(t.links, R.collapse_amounts(typed(t)), "round_id"), ["round_id", "investor_id"]).groupBy("investor_id").agg(F.count("*").alias("n")),
  CLUSTER + ", s as (select id as loser, first_value(id) over (partition by company_id, amount_raised, cluster order by kind is not null desc, announced_date is not null desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, news_url is not null desc, id) as survivor from c) select investor_id, count(distinct coalesce(survivor, round_id)) as n from links left join s on round_id = loser group by 1")
q("M26_exactly_one", lambda t: M.exactly_one(t.rounds.where("id = 77").select("id", "company_id")), "select id, company_id from rounds where id = 77")
q("M27_cleared_facts", lambda t: t.companies.select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("total_raised_usd").cast("double")).alias("total")), "select id, case when id % 10 = 0 then null else cast(total_raised_usd as double) end as total from companies")
q("M28_website_reset", lambda t: t.companies.select("id", F.when(F.col("website").rlike(r"//www\.c6\d\."), None).otherwise(F.col("website")).alias("website")), r"select id, case when regexp_matches(website, '//www\.c6\d\.') then null else website end as website from companies")
q("M31_status_events", lambda t: t.companies.join(W.first_per(t.rounds.where("confidence in ('medium', 'high') and id % 6 = 0"), ["company_id"], [F.desc_nulls_last("announced_date"), F.desc("id")]).select(F.col("company_id").alias("cid")), F.col("id") == F.col("cid"), "left").select("id", F.when((F.col("status") == "active") & F.col("cid").isNotNull(), "acquired").otherwise(F.col("status")).alias("status")),
  "select id, case when status = 'active' and exists (select 1 from rounds where company_id = c.id and confidence in ('medium', 'high') and rounds.id % 6 = 0) then 'acquired' else status end as status from companies c")
q("M32_newest_total", lambda t: t.rounds.where("announced_date is not null and amount_raised is not null").groupBy("company_id").agg(F.max_by("amount_raised", F.struct("announced_date", "id")).cast("double").alias("total")), "select company_id, cast(amount_raised as double) as total from (select *, row_number() over (partition by company_id order by announced_date desc, id desc) as n from rounds where announced_date is not null and amount_raised is not null) where n = 1")
q("M34_exit_cohort", lambda t: t.counted.select("id", F.when(F.expr("exclusion_reason is null and (description_short is not null or funding_round_count > 0)"), F.col("funding_round_count")).alias("score")), "select id, case when exclusion_reason is null and (description_short is not null or funding_round_count > 0) then funding_round_count end as score from counted")
q("M35_roster_match", lambda t: t.raw("customer").select(F.col("c_custkey").alias("company_id"), F.explode(F.array(F.col("c_name"), F.upper("c_name"), F.lit("Nobody"))).alias("person")).withColumn("key", F.lower("person")).join(t.companies.select(F.col("id").alias("company_id"), F.lower("name").alias("key")), ["company_id", "key"], "left_semi").dropDuplicates(["company_id", "key"]).select("company_id", "key"),
  "select id as company_id, lower(name) as key from companies")
q("J33_attached_news", lambda t: L.attach_news(news(t), t.rounds),
  f"with {NEWS}, k as (select *, regexp_replace(url, '^https?://(www[.])?', '') as key from news), p as (select company_id, regexp_replace(news_url, '^https?://(www[.])?', '') as key, min(id) as found from rounds where news_url is not null group by 1, 2), u as (select k.id, found as round_id from k join p using (company_id, key) where round_id is null), b as (select n.id, r.id as round_id, row_number() over (partition by n.id order by abs(published_date - announced_date), amount_raised desc nulls last, r.id) as n from news n join rounds r on n.company_id = r.company_id and abs(published_date - announced_date) <= 14 where n.round_id is null and n.id not in (select id from u)) select id, round_id, 'link' as how from news where round_id is not null union all select id, round_id, 'url' from u union all select id, round_id, 'time' from b where n = 1")
q("J34_proximity", lambda t: typed(t).alias("a").join(typed(t).alias("b"), F.expr("a.company_id = b.company_id and a.id < b.id and a.round_type <=> b.round_type and abs(datediff(a.announced_date, b.announced_date)) <= 60")).select(F.expr("a.id as first_id"), F.expr("b.id as second_id")),
  f"with {TYPED} select a.id as first_id, b.id as second_id from typed a join typed b on a.company_id = b.company_id and a.id < b.id and a.round_type is not distinct from b.round_type and abs(a.announced_date - b.announced_date) <= 60")
q("G25_coverage", lambda t: L.coverage(news(t), t.rounds),
  f"with {NEWS}, a as (select id as round_id, news_url as url, 0 as tier, 0 as id from rounds where news_url is not null union all select round_id, url, 1, id from news where round_id is not null), k as (select *, regexp_replace(url, '^https?://(www[.])?', '') as key from a) select round_id, key, min(tier) as tier from k group by 1, 2")
q("G26_timeline_tiers", lambda t: t.rounds.select("id", F.when(F.col("announced_date").isNull(), 0).otherwise(1).alias("tier"), F.col("announced_date").alias("day")).unionByName(news(t).select("id", F.when(F.col("published_date").isNull(), 2).otherwise(1).alias("tier"), F.col("published_date").alias("day"))).orderBy("tier", F.desc_nulls_last("day"), "id").limit(200),
  f"with {NEWS} select * from (select id, case when announced_date is null then 0 else 1 end as tier, announced_date as day from rounds union all select id, case when published_date is null then 2 else 1 end, published_date from news) order by tier, day desc nulls last, id limit 200")
q("G24_stories", lambda t: L.stories(news(t)))
q("G16_themes_over_rows", lambda t: C.themes(t.raw("embeddings"), "label", "vec_id", "embedding", local=0))
q("G19_rebuilt_themes", lambda t: (lambda v, place: (C.rebuild_themes(v, place, "label", "vec_id", "embedding"), C.rebuild_themes(v.where("label % 2 = 0"), place, "label", "vec_id", "embedding"))[1])(t.raw("embeddings"), new_place(t.spark, "themes")).select("label", "slug", "vec_id"))
q("G22_rebuilt_map", lambda t: (lambda v, place: (C.rebuild_map(v, place, "label", "vec_id", "embedding"), C.rebuild_map(v.where("label < 3"), place, "label", "vec_id", "embedding"))[1])(t.raw("embeddings"), new_place(t.spark, "map")).select("label", "vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))
q("G16_themes", lambda t: C.themes(t.raw("embeddings"), "label", "vec_id", "embedding"))
q("G20_map_positions", lambda t: C.project(t.raw("embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")))
q("G23_axis_scale", lambda t: C.scale_axis(t.raw("embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("v")), "label", "v", 40.0, 960.0, "x").select("vec_id", F.round("x", 5).alias("x")),
  "select vec_id, round(case when max(v) over w - min(v) over w < 1e-9 then 500 else 40 + (v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0) * 920 end, 5) as x from (select vec_id, label, cast(embedding[1] as double) as v from embeddings) window w as (partition by label)")
q("G27_source_buckets", lambda t: t.rounds.groupBy(F.when(F.col("news_url").isNull(), "unreachable").when(F.col("id") % 3 == 0, "stored").when(F.col("news_url").startswith("https://news."), "refetch").otherwise("other").alias("bucket")).agg(F.count("*").alias("n")),
  "select case when news_url is null then 'unreachable' when id % 3 = 0 then 'stored' when news_url like 'https://news.%' then 'refetch' else 'other' end as bucket, count(*) as n from rounds group by 1")
q("M24_purge_keeping_linked", lambda t: (lambda kept: t.rounds.where("news_url is not null").join(kept, F.col("id") == F.col("round_id"), "left").select("id", F.coalesce("url", "news_url").alias("news_url")))(news(t).where("round_id is not null and id % 5 <> 0").groupBy("round_id").agg(F.min_by("url", "id").alias("url"))),
  f"with {NEWS}, k as (select round_id, arg_min(url, id) as url from news where round_id is not null and id % 5 <> 0 group by 1) select id, coalesce(url, news_url) as news_url from rounds left join k on id = round_id where news_url is not null")
q("H38_investor_sets", lambda t: t.links.groupBy("round_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("investor_id")), lambda x: x.cast("string")), ",").alias("investors")), "select round_id, string_agg(distinct cast(investor_id as varchar), ',' order by investor_id) as investors from links group by 1" .replace("string_agg(distinct cast(investor_id as varchar), ',' order by investor_id)", "array_to_string(list_sort(list(distinct investor_id)), ',')"))
q("J37_two_keyed_texts", lambda t: (lambda n: n.where("round_id is not null").select("round_id", "id").unionByName(n.join(t.rounds.where("news_url is not null").select("company_id", F.col("news_url").alias("url"), F.col("id").alias("rid")), ["company_id", "url"]).select(F.col("rid").alias("round_id"), "id")).distinct())(news(t)),
  f"with {NEWS} select round_id, id from news where round_id is not null union select r.id, n.id from news n join rounds r on n.company_id = r.company_id and n.url = r.news_url")
q("J36_drifted_claims", lambda t: t.rounds.where("amount_raised is not null").withColumn("claim", F.concat(F.lit("raised "), N.claim_usd(F.col("amount_raised")))).withColumn("stored", F.when(F.col("id") % 8 == 0, "raised $1M").otherwise(F.col("claim"))).where("claim <> stored").select("id", "claim"),
  "select id, 'raised $' || case when amount_raised >= 1000 then printf('%.0fK', cast(amount_raised as double) / 1000) else printf('%.0f', cast(amount_raised as double)) end as claim from rounds where amount_raised is not null and id % 8 = 0")


def doubled(t):
    """Parts as companies: some share a site, names are alike, and what a judge may see."""
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.expr("case when p_partkey % 4 = 0 then concat('https://www.d', cast(p_partkey % 60 as string), '.example.com/x') when p_partkey % 4 = 1 then 'https://github.io/y' end").alias("website"),
        F.col("p_brand").alias("hq_city"), F.expr("case when p_partkey % 3 > 0 then p_type end").alias("hq_state"), F.expr("case when p_partkey % 5 = 0 then p_type end").alias("description_long"),
        F.expr("date '2001-07-31' - cast(p_partkey % 400 as int)").alias("created_at"), "p_size")


def judge(a, b):
    return abs(a["p_size"] - b["p_size"]) <= 12


q("H22_whole_dedup", lambda t: dedup_companies(doubled(t), judge, ["website", "hq_city", "hq_state", "description_long"], most=None)[1])
q("H22_deduped_companies", lambda t: dedup_companies(doubled(t), judge, ["website", "hq_city", "hq_state", "description_long"], most=None)[0].select("id", "website", "hq_city", "hq_state", "description_long"))
q("M13_judged_in_order", lambda t: judged_remap(doubled(t), name_pairs(doubled(t), MOST_JUDGED), judge).select("a", "b", F.round("similarity", 6).alias("similarity"), "merged", "loser", "survivor"))
q("H22_domain_remap", lambda t: domain_remap(doubled(t)), """with c as (select p_partkey as id, 'd' || p_partkey % 60 as domain, coalesce(case when p_partkey % 5 = 0 then p_type end, '') = '' as u, date '2001-07-31' - cast(p_partkey % 400 as int) as made from part where p_partkey % 4 = 0)
 select id as loser, survivor from (select id, first_value(id) over (partition by domain order by u, made, id) as survivor from c) where id <> survivor""")
