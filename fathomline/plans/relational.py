"""Filters, joins, ordering and set operations over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import predicates as P
from fathomline.operators import windows as W
from fathomline.plans.registry import q
from fathomline.sources.tables import AS_OF


def day():
    return F.lit(AS_OF).cast("date")


D = f"date '{AS_OF}'"

# scans
q("S1_scan_projected", lambda t: t.companies.select("id", "name", "industry_group"), "select id, name, industry_group from companies")
q("S2_keyset_page", lambda t: W.keyset_page(t.companies.select("slug", "name"), "slug", "co-3", 50),
  "select slug, name from companies where slug > 'co-3' order by slug limit 50")
q("S4_tally_by_company", lambda t: t.competitors.groupBy("company_id").agg(F.count("*").alias("n")),
  "select company_id, count(*) as n from competitors group by 1")
q("S5_funded_ids", lambda t: t.rounds.select("company_id").distinct(), "select distinct company_id from rounds")

# filters
q("F1_shown", lambda t: t.shown.select("id", "slug", "funding_round_count"), "select id, slug, funding_round_count from shown")
q("F2_filter_builder",
  lambda t: P.filter_companies(t.shown, q="maker no. 1", industry="BUILDING", emp_min=50, emp_max=400, has_website=True, status="active", tag=None).select("id", "name"),
  "select id, name from shown where (name ilike '%maker no. 1%' or description_short ilike '%maker no. 1%') and industry_group = 'BUILDING' and coalesce(status, 'active') = 'active' and employee_count_max >= 50 and employee_count_min <= 400 and website is not null")


def tags():
    return F.array(F.concat(F.lit("t"), F.col("id") % 9), F.concat(F.lit("t"), F.col("id") % 5), F.lower("industry_group"))


TAGS_SQL = "list_value(concat('t', id % 9), concat('t', id % 5), lower(industry_group))"
q("F3_array_contains", lambda t: t.companies.withColumn("tags", tags()).where(F.array_contains("tags", "t3")).select("id"),
  f"select id from companies where list_contains({TAGS_SQL}, 't3')")
q("F4_range_overlap", lambda t: t.companies.where(P.employee_overlap(100, 200)).select("id", "employee_count_min", "employee_count_max"),
  "select id, employee_count_min, employee_count_max from companies where employee_count_max >= 100 and employee_count_min <= 200")
q("F5_relative_date", lambda t: t.rounds.where(P.within_days("announced_date", 90, AS_OF)).select("id", "announced_date"),
  f"select id, announced_date from rounds where announced_date >= {D} - 90")
q("F6_ilike_two_columns", lambda t: t.companies.where(P.matches_any(["name", "description_short"], "MACHINERY maker")).select("id"),
  "select id from companies where name ilike '%MACHINERY maker%' or description_short ilike '%MACHINERY maker%'")
q("F7_sanitize_term", lambda t: t.raw("documents").select("doc_id", P.sanitized(F.col("text")).alias("term")),
  r"select doc_id, trim(regexp_replace(regexp_replace(text, '[,()%*\\]', ' ', 'g'), '\s+', ' ', 'g')) as term from documents")
q("F8_null_predicates", lambda t: t.companies.where(F.col("website").isNull() & F.col("status").isNotNull() & F.col("hq_country").isin("CHINA", "FRANCE") & (F.col("id") >= 10)).select("id"),
  "select id from companies where website is null and status is not null and hq_country in ('CHINA', 'FRANCE') and id >= 10")
q("F9_in_list", lambda t: t.companies.where(F.col("slug").isin([f"co-{n}" for n in range(1, 400, 2)][:150])).select("id"),
  "select id from companies where id % 2 = 1 and id <= 299")
q("F10_any_pattern", lambda t: t.competitors.where(P.any_pattern("reasoning", ["%dropped%", "%not a rival%"])).select("company_id", "rank"),
  "select company_id, rank from competitors where reasoning ilike '%dropped%' or reasoning ilike '%not a rival%'")
q("F11_regex_ci", lambda t: t.raw("documents").where(F.col("text").rlike("(?i)\\bthe (and|of|to)\\b")).select("doc_id"),
  r"select doc_id from documents where regexp_matches(text, '(?i)\bthe (and|of|to)\b')")
q("F12_affixes", lambda t: t.raw("pages").where(F.col("url").startswith("https://") & (F.col("url").endswith("top") | F.col("url").like("%/en/%"))).select("page_id"),
  "select page_id from pages where url like 'https://%' and (url like '%top' or url like '%/en/%')")
q("F13_needs_canonical", lambda t: t.companies.where(~F.col("hq_country").isin("CHINA", "FRANCE") & F.initcap(F.lower("hq_country")).isin("China", "France", "Kenya")).select("id"),
  "select id from companies where hq_country not in ('CHINA', 'FRANCE') and hq_country = 'KENYA'")


def hashed():
    return F.sha2(F.concat_ws("\n", F.col("name"), F.coalesce("description_short", F.lit("")), F.coalesce("industry_group", F.lit(""))), 256)


q("F14_content_hash", lambda t: t.companies.select("id", hashed().alias("text_hash")),
  "select id, sha256(concat_ws(chr(10), name, coalesce(description_short, ''), coalesce(industry_group, ''))) as text_hash from companies")
q("F15_version_gate", lambda t: t.companies.where(P.outdated("prompt_version", "v2")).select("id"), "select id from companies where prompt_version is null or prompt_version < 'v2'")
q("F16_ttl", lambda t: t.companies.where(P.stale("checked_at", 30, AS_OF)).select("id"), f"select id from companies where checked_at is null or checked_at < {D} - 30")
q("F17_meta_leak", lambda t: t.competitors.where(~P.leaks_meta()).select("company_id", "rank"),
  "select company_id, rank from competitors where not regexp_matches(coalesce(reasoning, ''), '(?i)should be dropped|should be excluded|not a (real )?competitor')")
q("F19_display_fallback", lambda t: t.companies.select("id", F.coalesce("status", F.lit("active")).alias("status")), "select id, coalesce(status, 'active') as status from companies")
q("F20_required_fields", lambda t: t.rounds.join(t.companies.select(F.col("id").alias("company_id"), "name"), "company_id").dropna(subset=["amount_raised", "announced_date"]).select("id", "name"),
  "select r.id, name from rounds r join companies c on company_id = c.id where amount_raised is not null and announced_date is not null")
q("F21_soft_exclude", lambda t: t.companies.select("id", F.when(F.col("slug") == "co-34", None).when(F.col("slug") == "co-35", "duplicate").otherwise(F.col("exclusion_reason")).alias("exclusion_reason")),
  "select id, case when slug = 'co-34' then null when slug = 'co-35' then 'duplicate' else exclusion_reason end as exclusion_reason from companies")


# joins
def round_feed(t, condition=None, limit=30):
    c = t.companies.where(P.not_excluded()).select(F.col("id").alias("company_id"), "name", "slug", "industry_group")
    df = t.rounds.where("announced_date is not null").join(c, "company_id")
    if condition is not None:
        df = df.where(condition)
    return df.orderBy(F.desc("announced_date"), F.asc("id")).limit(limit).select("id", "slug", "announced_date", F.col("amount_raised").cast("double").alias("amount"))


def feed_sql(condition="true", limit=30):
    return f"select r.id, slug, announced_date, cast(amount_raised as double) as amount from rounds r join companies c on company_id = c.id where exclusion_reason is null and announced_date is not null and {condition} order by announced_date desc, r.id limit {limit}"


q("J1_round_company_feed", round_feed, feed_sql())
q("J2_feed_by_industry", lambda t: round_feed(t, F.col("industry_group") == "MACHINERY"), feed_sql("industry_group = 'MACHINERY'"))
q("J3_feed_by_slugs", lambda t: round_feed(t, F.col("slug").isin("co-1", "co-2", "co-4", "co-5", "co-7", "co-8")), feed_sql("slug in ('co-1', 'co-2', 'co-4', 'co-5', 'co-7', 'co-8')"))


def news(t):
    """Documents as news of a company, a day each."""
    return t.raw("documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 150 + 1).alias("company_id"), F.expr("date '2001-07-31' - cast(doc_id % 300 as int)").alias("published_date"),
        F.concat(F.lit("https://news.example.com/"), F.col("doc_id") % 900).alias("url"), F.substring("text", 1, 60).alias("title"), "source", F.expr("case when doc_id % 7 = 0 then doc_id * 4 end").alias("round_id"))


NEWS = "news as (select doc_id as id, doc_id % 150 + 1 as company_id, date '2001-07-31' - cast(doc_id % 300 as int) as published_date, concat('https://news.example.com/', doc_id % 900) as url, substring(text, 1, 60) as title, source, case when doc_id % 7 = 0 then doc_id * 4 end as round_id from documents)"


def news_feed(t, condition=None):
    c = t.companies.where(P.not_excluded()).select(F.col("id").alias("company_id"), "slug", "industry_group")
    df = news(t).join(c, "company_id")
    return (df if condition is None else df.where(condition)).orderBy(F.desc("published_date"), "id").limit(30).select("id", "slug", "published_date")


q("J4_news_feed", news_feed, f"with {NEWS} select n.id, slug, published_date from news n join companies c on company_id = c.id where exclusion_reason is null order by published_date desc, n.id limit 30")
q("J5_news_by_industry", lambda t: news_feed(t, F.col("industry_group") == "BUILDING"),
  f"with {NEWS} select n.id, slug, published_date from news n join companies c on company_id = c.id where exclusion_reason is null and industry_group = 'BUILDING' order by published_date desc, n.id limit 30")


def nested_rounds(t):
    inv = t.investors.select(F.col("id").alias("investor_id"), F.col("name").alias("investor"))
    names = t.links.join(inv, "investor_id").groupBy("round_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_lead"), F.col("investor")))).alias("leads"), F.array_sort(F.collect_set(F.when(~F.col("is_lead"), F.col("investor")))).alias("others"))
    return t.rounds.join(names, F.col("id") == F.col("round_id"), "left").select("id", "company_id", F.array_join("leads", ", ").alias("leads"), F.array_join("others", ", ").alias("others"))


q("J6_nested_investors", nested_rounds,
  "with n as (select round_id, string_agg(distinct i.name, ', ' order by i.name) filter (is_lead) as leads, string_agg(distinct i.name, ', ' order by i.name) filter (not is_lead) as others from links join investors i on investor_id = i.id group by 1) select r.id, company_id, case when round_id is not null then coalesce(leads, '') end as leads, case when round_id is not null then coalesce(others, '') end as others from rounds r left join n on r.id = round_id")


def rivals(t):
    c = t.companies.select(F.col("id").alias("competitor_company_id"), F.col("slug").alias("rival_slug"), F.col("exclusion_reason").alias("gone"))
    out = t.competitors.join(c, "competitor_company_id", "left")
    return out.select("company_id", "rank", "competitor_name", F.when(F.col("gone").isNull(), F.col("rival_slug")).alias("rival_slug"))


RIVALS = "rivals as (select company_id, rank, competitor_name, case when exclusion_reason is null then c.slug end as rival_slug from competitors left join companies c on competitor_company_id = c.id)"
q("J7_optional_self_reference", rivals, f"with {RIVALS} select * from rivals")
q("J8_resolved_and_not", lambda t: rivals(t).groupBy(F.col("rival_slug").isNotNull().alias("resolved")).agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("companies")),
  f"with {RIVALS} select rival_slug is not null as resolved, count(*) as n, count(distinct company_id) as companies from rivals group by 1")
q("J10_two_references", lambda t: t.competitors.alias("k").join(t.companies.alias("a"), F.expr("k.company_id = a.id")).join(t.companies.alias("b"), F.expr("k.competitor_company_id = b.id"), "left").select(F.expr("a.slug as slug"), F.expr("b.slug as prior_slug"), "k.rank"),
  "select a.slug as slug, b.slug as prior_slug, rank from competitors k join companies a on k.company_id = a.id left join companies b on competitor_company_id = b.id")


def edge_exists(t):
    pairs = t.spark.createDataFrame([(1, 9), (9, 1), (2, 3), (10, 71)], "a long, b long")
    e = t.competitors.select("company_id", "competitor_company_id")

    e2 = e.unionByName(e.select(F.col("competitor_company_id").alias("company_id"), F.col("company_id").alias("competitor_company_id")))
    hit = pairs.join(e2, (F.col("a") == F.col("company_id")) & (F.col("b") == F.col("competitor_company_id")), "left_semi").withColumn("hit", F.lit(True))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("related"))


q("J13_undirected_edge", edge_exists,
  "select a, b, exists (select 1 from competitors where (company_id = a and competitor_company_id = b) or (company_id = b and competitor_company_id = a)) as related from (values (1, 9), (9, 1), (2, 3), (10, 71)) v(a, b)")


def portfolio(t):
    direct = t.company_links.select("investor_id", "company_id")
    through = t.links.join(t.rounds.select(F.col("id").alias("round_id"), "company_id"), "round_id").select("investor_id", "company_id")
    return direct, through


LEGS = "legs as (select investor_id, company_id from company_links union select investor_id, company_id from links join rounds r on round_id = r.id)"
q("J14_portfolio", lambda t: (lambda d, r: d.union(r.join(d, ["investor_id", "company_id"], "left_anti")).where("investor_id = 7").distinct().join(t.companies, F.expr("company_id = id")).orderBy("name", "id").offset(10).limit(40).select("id", "name"))(*portfolio(t)),
  f"with {LEGS} select id, name from legs join companies on company_id = id where investor_id = 7 order by name, id limit 40 offset 10")


def compare(t):
    slugs = ["co-9", "co-2", "co-99999999", "co-5", "co-1"]
    asked = t.spark.range(1).select(F.posexplode(F.array(*map(F.lit, slugs))).alias("pos", "slug"))
    return t.companies.join(F.broadcast(asked), "slug").orderBy("pos").select("pos", "slug", "name")  # as many rows as were asked for


q("J15_input_order", compare, "select cast(pos as int) as pos, slug, name from (values (0, 'co-9'), (1, 'co-2'), (2, 'co-99999999'), (3, 'co-5'), (4, 'co-1')) v(pos, slug) join companies using (slug)")
q("J17_alias_redirect", lambda t: t.companies.where("id % 50 = 0").select(F.concat(F.lit("old-"), F.col("id")).alias("old_slug"), (F.col("id") - 1).alias("target")).join(t.companies.select(F.col("id").alias("target"), "slug"), "target").select("old_slug", "slug"),
  "select concat('old-', a.id) as old_slug, b.slug from companies a join companies b on b.id = a.id - 1 where a.id % 50 = 0")
q("J18_name_dictionary", lambda t: t.investors.select(F.lower("name").alias("key"), "slug"), "select lower(name) as key, slug from investors")
q("J22_domain_match", lambda t: (lambda h: h.groupBy("host").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1"))(t.companies.select("id", F.regexp_extract("website", r"^https?://(?:www\.)?([^/:?#]+)", 1).alias("host")).where("host <> ''")),
  r"select regexp_extract(website, '^https?://(?:www\.)?([^/:?#]+)', 1) as host, min(id) as id, count(*) as n from companies where website is not null group by 1 having count(*) > 1")
q("J23_exists", lambda t: t.companies.join(t.rounds.where("amount_raised > 300000"), t.companies["id"] == F.col("company_id"), "left_semi").select("id"),
  "select id from companies c where exists (select 1 from rounds r where r.company_id = c.id and amount_raised > 300000)")
q("J24_not_exists", lambda t: t.companies.join(t.rounds.select("company_id"), F.col("id") == F.col("company_id"), "left_anti").select("id"), "select id from companies c where not exists (select 1 from rounds r where r.company_id = c.id)")
KEYS5 = ["company_id", "confidence", "round_type", "announced_date", "news_url"]
q("J25_composite_anti", lambda t: t.rounds.join(t.rounds.where("id % 6 = 0").select(*KEYS5), KEYS5, "left_anti").select("id"),
  "select id from rounds a where not exists (select 1 from rounds b where b.id % 6 = 0 and a.company_id = b.company_id and a.confidence = b.confidence and a.round_type = b.round_type and a.announced_date = b.announced_date and a.news_url = b.news_url)")


def exists_either(t):
    a = t.rounds.where("amount_raised > 400000").select(F.col("company_id").alias("id")).distinct().withColumn("a", F.lit(1))
    b = t.competitors.where("rank = 2").select(F.col("company_id").alias("id")).distinct().withColumn("b", F.lit(1))
    return t.companies.select("id").join(a, "id", "left").join(b, "id", "left").where("a is not null or b is not null").select("id")


q("J26_exists_either", exists_either, "select id from companies c where exists (select 1 from rounds where company_id = c.id and amount_raised > 400000) or exists (select 1 from competitors k where k.company_id = c.id and rank = 2)")


def null_or_stale(t):
    last = t.rounds.groupBy("company_id").agg(F.max("announced_date").alias("last"))
    return t.companies.join(last, F.col("id") == F.col("company_id"), "left").where(P.stale("last", 400, AS_OF)).select("id", "last")


STALE = f"select id, last from companies left join (select company_id, max(announced_date) as last from rounds group by 1) on id = company_id where last is null or last < {D} - 400"
q("J27_null_or_stale", null_or_stale, STALE)
q("J28_three_way_worklist", lambda t: null_or_stale(t).join(t.companies.select("id", "website", "checked_at"), "id").where(F.col("website").isNotNull() & (F.col("last").isNull() | F.col("checked_at").isNull() | (F.col("checked_at") < F.date_sub(day(), 60)))).select("id"),
  f"select s.id from ({STALE}) s join companies c on c.id = s.id where website is not null and (last is null or checked_at is null or checked_at < {D} - 60)")
q("J29_row_at_maximum", lambda t: W.at_maximum(t.runs, ["stage"], "started_at").select("id", "stage", "started_at"), "select id, stage, started_at from runs r where started_at = (select max(started_at) from runs x where x.stage = r.stage)")
q("J30_bounds_cross_join", lambda t: t.rounds.select("id", (F.col("announced_date") >= F.add_months(F.trunc(day(), "quarter"), -6)).alias("recent")), f"with bounds as (select date_trunc('quarter', {D}) - interval 6 months as lo) select id, announced_date >= lo as recent from rounds cross join bounds")


def trailing_count(t):
    n = t.raw("orders").selectExpr("o_custkey as cid", "cast(o_orderdate as date) as d").where((F.col("d") > F.date_sub(day(), 365)) & (F.col("d") <= day())).groupBy("cid").agg(F.count("*").alias("n"))
    return t.companies.join(n, F.col("id") == F.col("cid"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


q("J31_range_count", trailing_count, f"select id, (select count(*) from orders where o_custkey = id and cast(o_orderdate as date) > {D} - 365 and cast(o_orderdate as date) <= {D}) as n from companies")
q("J32_update_from_join", lambda t: (lambda r: news(t).join(r, ["company_id", "url"], "left").select("id", F.coalesce("round_id", "found").alias("round_id")))(t.rounds.groupBy("company_id", F.col("news_url").alias("url")).agg(F.min("id").alias("found"))),
  f"with {NEWS} select n.id, coalesce(round_id, (select min(r.id) from rounds r where r.company_id = n.company_id and r.news_url = n.url)) as round_id from news n")
q("J35_in_subquery", lambda t: t.companies.join(t.competitors.select(F.col("competitor_company_id").alias("id")).distinct(), "id", "left_semi").select("id"), "select id from companies where id in (select distinct competitor_company_id from competitors)")


def unique_name(t):
    names = t.companies.groupBy(F.col("description_short").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("found")).where("n = 1 and key is not null")
    return t.companies.join(names, F.col("description_short") == F.col("key"), "left").select("id", "found")


q("J38_unique_name", unique_name, "with u as (select description_short as key, min(id) as found from companies where description_short is not null group by 1 having count(*) = 1) select id, found from companies left join u on description_short = key")
q("J39_max_per_group", lambda t: (lambda m: t.companies.where("exclusion_reason is not null").join(m, F.col("id") == F.col("company_id")).where("top >= 350000").select("id", F.col("top").cast("double").alias("top")))(t.rounds.groupBy("company_id").agg(F.max("amount_raised").alias("top"))),
  "select c.id, cast(max(amount_raised) as double) as top from companies c join rounds r on company_id = c.id where exclusion_reason is not null group by 1 having max(amount_raised) >= 350000")
q("J16_member_chain", lambda t: t.companies.where("industry_group = 'BUILDING'").join(t.rounds.select("company_id", F.col("id").alias("round_id")), F.col("id") == F.col("company_id")).join(t.links, "round_id").join(t.investors.select(F.col("id").alias("investor_id"), "kind"), "investor_id").groupBy("kind").agg(F.count("*").alias("n")),
  "select kind, count(*) as n from companies c join rounds r on company_id = c.id join links l on l.round_id = r.id join investors i on investor_id = i.id where industry_group = 'BUILDING' group by 1")

# sort, limit, top-k
L1 = {"name": (lambda: ["name"], "name"), "raised": (lambda: [F.desc_nulls_last("total_raised_usd"), F.asc("name")], "total_raised_usd desc nulls last, name"), "oldest": (lambda: [F.asc_nulls_last("checked_at"), F.asc("name")], "checked_at asc nulls last, name")}
for key, (order, text) in L1.items():
    q(f"L1_sort_{key}", lambda t, order=order: t.shown.orderBy(*order()).limit(60).select("id", "name"), f"select id, name from shown order by {text} limit 60")
q("L2_page_and_total", lambda t: t.shown.crossJoin(F.broadcast(t.shown.agg(F.count("*").alias("total")))).orderBy("name").offset(40).limit(20).select("id", "total"),
  "select id, (select count(*) from shown) as total from shown order by name limit 20 offset 40")


def biggest(t):
    top = t.rounds.where(P.within_days("announced_date", 365, AS_OF)).orderBy(F.desc_nulls_last("amount_raised"), "id").limit(80)
    top = W.first_per(top, ["company_id", "round_type", "amount_raised"], [F.asc("id")])
    return top.orderBy(F.desc_nulls_last("amount_raised"), "id").limit(20).select("id", "company_id")


q("L3_biggest_recent", biggest, f"with top as (select * from rounds where announced_date >= {D} - 365 order by amount_raised desc nulls last, id limit 80), one as (select *, row_number() over (partition by company_id, round_type, amount_raised order by id) as n from top) select id, company_id from one where n = 1 order by amount_raised desc nulls last, id limit 20")
q("L4_preferred_newest", lambda t: t.companies.orderBy(F.desc("created_at"), "id").limit(36).orderBy(F.desc(F.col("description_short").isNotNull()), F.desc("created_at"), "id").limit(12).select("id"),
  "select id from (select * from companies order by created_at desc, id limit 36) order by description_short is not null desc, created_at desc, id limit 12")
q("L6_top_by_total", lambda t: t.shown.where("industry_group = 'MACHINERY'").orderBy(F.desc_nulls_last("total_raised_usd"), "id").limit(400).select("id"), "select id from shown where industry_group = 'MACHINERY' order by total_raised_usd desc nulls last, id limit 400")
q("L7_new_this_week", lambda t: t.shown.where(P.within_days("created_at", 7, AS_OF)).orderBy(F.desc("created_at"), "id").limit(200).select("id", "created_at"), f"select id, created_at from shown where created_at >= {D} - 7 order by created_at desc, id limit 200")
q("L8_investors_page", lambda t: t.investors.join(t.links.groupBy(F.col("investor_id").alias("id")).agg(F.countDistinct("round_id").alias("n")), "id", "left").orderBy(F.desc_nulls_last("n"), "name").offset(20).limit(20).select("id", "n"),
  "select i.id, n from investors i left join (select investor_id, count(distinct round_id) as n from links group by 1) on i.id = investor_id order by n desc nulls last, name limit 20 offset 20")
q("L15_prominence_worklist", lambda t: t.counted.where("website is null").orderBy(F.desc_nulls_last("total_raised_usd"), F.desc("funding_round_count"), "id").limit(100).select("id"), "select id from counted where website is null order by total_raised_usd desc nulls last, funding_round_count desc, id limit 100")
q("L16_boolean_tiers", lambda t: t.companies.orderBy(F.desc(F.col("description_short").isNull()), F.desc(F.col("website").isNull()), "id").limit(150).select("id"), "select id from companies order by description_short is null desc, website is null desc, id limit 150")
q("L17_rotation", lambda t: t.companies.orderBy(F.asc_nulls_first("checked_at"), "id").limit(300).select("id", "checked_at"), "select id, checked_at from companies order by checked_at asc nulls first, id limit 300")
q("L19_merged_feed", lambda t: t.rounds.select("id", F.lit("round").alias("kind"), F.col("announced_date").alias("day")).unionByName(news(t).select("id", F.lit("news").alias("kind"), F.col("published_date").alias("day"))).orderBy(F.desc_nulls_last("day"), "kind", "id").limit(50),
  f"with {NEWS} select id, 'round' as kind, announced_date as day from rounds union all select id, 'news', published_date from news order by day desc nulls last, kind, id limit 50")
q("L21_recent_runs", lambda t: t.runs.orderBy(F.desc("started_at"), "id").limit(400).select("id", "stage"), "select id, stage from runs order by started_at desc, id limit 400")
q("L22_peers", lambda t: t.companies.where("industry_group = 'BUILDING' and id <> 12").orderBy("name").limit(50).select("id"), "select id from companies where industry_group = 'BUILDING' and id <> 12 order by name limit 50")
q("L23_husk_search", lambda t: t.counted.where(P.not_excluded() & F.col("description_short").isNull() & F.col("name").ilike("%00001%")).orderBy("name").limit(10).select("id"), "select id from counted where exclusion_reason is null and description_short is null and name ilike '%00001%' order by name limit 10")

# set operations
q("U1_union_distinct", lambda t: (lambda d, r: d.union(r).distinct())(*portfolio(t)), f"with {LEGS} select * from legs")
q("U2_union_count", lambda t: (lambda d, r: d.union(r).distinct().groupBy("investor_id").agg(F.count("*").alias("n")))(*portfolio(t)), f"with {LEGS} select investor_id, count(*) as n from legs group by 1")
q("U4_difference", lambda t: (lambda d, r: r.distinct().join(d, ["investor_id", "company_id"], "left_anti"))(*portfolio(t)), "select investor_id, company_id from links join rounds r on round_id = r.id except select investor_id, company_id from company_links")
q("U5_intersection_size", lambda t: t.companies.select("id", F.size(F.array_intersect(tags(), F.array(F.lit("t1"), F.lit("t2"), F.lit("building")))).alias("shared")),
  f"select id, cast(len(list_intersect({TAGS_SQL}, ['t1', 't2', 'building'])) as int) as shared from companies")
q("U6_names_capped", lambda t: t.links.join(t.rounds.select(F.col("id").alias("round_id"), "company_id"), "round_id").join(t.investors.select(F.col("id").alias("investor_id"), "name"), "investor_id").groupBy("company_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 8), ", ").alias("names")),
  "select company_id, array_to_string(list_sort(list(distinct i.name))[1:8], ', ') as names from links join rounds r on round_id = r.id join investors i on investor_id = i.id group by 1")

# windows


def latest_first():
    return [F.desc_nulls_last("announced_date"), F.desc("id")]


q("W1_latest_round", lambda t: W.first_per(t.rounds, ["company_id"], latest_first()).select("company_id", "id", "announced_date"), "select company_id, id, announced_date from (select *, row_number() over (partition by company_id order by announced_date desc nulls last, id desc) as n from rounds) where n = 1")
q("W2_lowest_rank", lambda t: W.first_per(t.competitors.where("competitor_company_id is not null"), ["company_id", "competitor_company_id"], [F.asc("rank")]).select("company_id", "competitor_company_id", "rank"),
  "select company_id, competitor_company_id, min(rank) as rank from competitors where competitor_company_id is not null group by 1, 2")
q("W4_trailing_window", lambda t: t.raw("orders").selectExpr("o_orderkey", "o_custkey", "datediff(cast(o_orderdate as date), date '1970-01-01') as day").withColumn("n", F.count("*").over(Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-30, 0))).select("o_orderkey", "n"),
  "select o_orderkey, count(*) over (partition by o_custkey order by cast(o_orderdate as date) range between interval 30 days preceding and current row) as n from orders")
q("W7_survivor_priority", lambda t: W.first_per(t.rounds.where("amount_raised is not null"), ["company_id"], [F.desc(F.col("round_type").isNotNull()), F.desc(F.col("announced_date").isNotNull()), F.desc(F.expr("case confidence when 'high' then 2 when 'medium' then 1 else 0 end")), F.asc("id")]).select("company_id", "id"),
  "select company_id, id from (select *, row_number() over (partition by company_id order by round_type is not null desc, announced_date is not null desc, case confidence when 'high' then 2 when 'medium' then 1 else 0 end desc, id) as n from rounds where amount_raised is not null) where n = 1")
q("W8_company_survivor", lambda t: W.first_per(t.companies.where("website is not null"), ["website"], [F.desc(F.col("description_short").isNotNull()), F.asc("created_at"), F.asc("id")]).select("website", "id"),
  "select website, id from (select *, row_number() over (partition by website order by description_short is not null desc, created_at, id) as n from companies where website is not null) where n = 1")
q("W9_investor_survivor", lambda t: W.first_per(t.links.groupBy("investor_id").agg(F.count("*").alias("n")).withColumn("bucket", F.col("investor_id") % 10), ["bucket"], [F.desc("n"), F.asc("investor_id")]).select("bucket", "investor_id", "n"),
  "select bucket, investor_id, n from (select *, row_number() over (partition by bucket order by n desc, investor_id) as r from (select investor_id % 10 as bucket, investor_id, count(*) as n from links group by 1, 2)) where r = 1")
q("W10_lowest_id", lambda t: t.competitors.groupBy("competitor_name").agg(F.min("company_id").alias("kept")), "select competitor_name, min(company_id) as kept from competitors group by 1")
q("W11_headline_survivor", lambda t: W.first_per(news(t).withColumn("key", F.lower(F.trim("title"))), ["company_id", "key"], [F.desc(F.col("round_id").isNotNull()), F.asc("published_date"), F.asc("id")]).select("id"),
  f"with {NEWS} select id from (select *, row_number() over (partition by company_id, lower(trim(title)) order by round_id is not null desc, published_date, id) as n from news) where n = 1")
q("W12_runner_up_gap", lambda t: W.runner_up_gap(t.rounds.where("amount_raised is not null").withColumn("score", F.col("amount_raised").cast("double")), ["company_id"], "score", "id").select("company_id", "id", F.round("gap", 2).alias("gap")),
  "select company_id, id, round(gap, 2) as gap from (select company_id, id, cast(amount_raised as double) - lead(cast(amount_raised as double)) over w as gap, row_number() over w as n from rounds where amount_raised is not null window w as (partition by company_id order by amount_raised desc, id)) where n = 1")
q("W13_shards", lambda t: W.shard(t.companies.select("slug"), "slug", 400).select("slug", "shard"), "select slug, (row_number() over (order by slug) - 1) // 400 as shard from companies")
