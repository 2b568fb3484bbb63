"""Scores, graph walks and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import graph as G
from fathomline.operators import scoring as S
from fathomline.operators import similarity as V
from fathomline.operators import windows as W
from fathomline.plans.aggregates import day, tags, D
from fathomline.plans.registry import q
from fathomline.plans.relational import NEWS, news
from fathomline.sources.tables import AS_OF

# momentum: orders stand for the news events that weekly snapshots count
EVENTS = "select o_custkey as id, cast(o_orderdate as date) as d from orders"
SNAP = f"snap as (select id, cast(date_trunc('week', d) as date) as captured_week, count(*) as news_count from ({EVENTS}) where d <= {D} and d > {D} - 700 group by 1, 2)"
WIN = f"win as (select id, avg(news_count) filter (captured_week > {D} - 140 and captured_week <= {D}) as recent, avg(news_count) filter (captured_week <= {D} - 210 and captured_week >= {D} - 630) as baseline from snap group by 1)"
RATIO = "case when recent is not null and baseline is not null then least(greatest((recent + 3.0) / (baseline + 3.0), 0.25), 4.0) end"


def snapshots(t):
    e = t.raw("orders").selectExpr("o_custkey as id", "cast(o_orderdate as date) as d").where((F.col("d") <= day()) & (F.col("d") > F.date_sub(day(), 700)))
    return e.groupBy("id", F.date_trunc("week", "d").cast("date").alias("captured_week")).agg(F.count("*").alias("news_count"))


def windows(t):
    return S.news_windows(snapshots(t), "id", AS_OF, 10)


q("W3_similar_top_k", lambda t: G.similar_edges(t.companies.select("id", "industry_group", tags().alias("tags"))),
  "with c as (select id, industry_group, list_distinct(list_value(concat('t', id % 9), concat('t', id % 5), lower(industry_group))) as tags from companies where industry_group is not null), p as (select a.id, b.id as related_id, len(list_intersect(a.tags, b.tags)) as shared, len(a.tags) as x, len(b.tags) as y from c a join c b on a.industry_group = b.industry_group and a.id <> b.id), s as (select id, related_id, shared, round(shared / (x + y - shared), 3) as score from p where shared > 0) select id, related_id, score, shared from (select *, row_number() over (partition by id order by score desc, shared desc, related_id) as n from s) where n <= 8".replace("where id <= 400 and", "where id <= 400 and"))
q("W5_two_window_means", lambda t: windows(t).select("id", F.round("recent", 6).alias("recent"), F.round("baseline", 6).alias("baseline")), f"with {SNAP}, {WIN} select id, round(recent, 6) as recent, round(baseline, 6) as baseline from win")
HC = "hc as (select c_custkey as id, cast(date_trunc('week', cast(o_orderdate as date)) as date) as captured_week, min(o_orderkey % 50 * 10) as lo, max(o_orderkey % 50 * 10 + 40) as hi from orders join customer on c_custkey = o_custkey group by 1, 2)"


def headcounts(t):
    o = t.raw("orders").selectExpr("o_custkey as id", "cast(date_trunc('week', o_orderdate) as date) as captured_week", "o_orderkey % 50 * 10 as v")
    return o.groupBy("id", "captured_week").agg(F.min("v").alias("lo"), (F.max("v") + 40).alias("hi"))


HCQ = f"{HC}, latest as (select id, max(captured_week) as last_week, arg_max((lo + hi) / 2.0, captured_week) as recent_mid from hc group by 1), base as (select h.id, arg_min((lo + hi) / 2.0, captured_week) as base_mid from hc h join latest l using (id) where captured_week <= last_week - 56 group by 1)"
q("W6_headcount_midpoints", lambda t: S.headcount_midpoints(headcounts(t), "id", "lo", "hi"), f"with {HCQ} select id, recent_mid, base_mid from latest left join base using (id)")
q("G1_news_component", lambda t: windows(t).select("id", F.round(S.news_component(S.news_ratio(F.col("recent"), F.col("baseline"))), 6).alias("news")), f"with {SNAP}, {WIN} select id, round(ln({RATIO} * 4) / (2 * ln(4.0)), 6) as news from win")


def latest_dates(t):
    return t.rounds.groupBy(F.col("company_id").alias("id")).agg(F.max("announced_date").alias("latest"))


q("G2_funding_component", lambda t: latest_dates(t).select("id", F.round(S.funding_component(S.funding_days(F.col("latest"), AS_OF)), 6).alias("funding")),
  f"select company_id as id, round(exp(-greatest({D} - max(announced_date), 0) / 180.0), 6) as funding from rounds group by 1 having max(announced_date) is not null union all select company_id, null from rounds group by 1 having max(announced_date) is null")
q("G3_headcount_component", lambda t: S.headcount_midpoints(headcounts(t), "id", "lo", "hi").select("id", F.round(S.headcount_component(S.headcount_growth(F.col("recent_mid"), F.col("base_mid"))), 6).alias("headcount")),
  f"with {HCQ} select id, round(least(greatest(0.5 + case when base_mid <> 0 then (recent_mid - base_mid) / base_mid end / 2, 0), 1), 6) as headcount from latest left join base using (id) where base_mid <> 0 union all select id, null from latest left join base using (id) where base_mid is null or base_mid = 0")


def momentum(t):
    facts = t.shown.select("id").join(windows(t), "id", "left").join(latest_dates(t), "id", "left").join(S.headcount_midpoints(headcounts(t), "id", "lo", "hi"), "id", "left")
    facts = facts.withColumns({"ratio": S.news_ratio(F.col("recent"), F.col("baseline")), "days": S.funding_days(F.col("latest"), AS_OF), "growth": S.headcount_growth(F.col("recent_mid"), F.col("base_mid"))})
    score = S.combine([(S.news_component(F.col("ratio")), S.NEWS_WEIGHT), (S.funding_component(F.col("days")), S.FUNDING_WEIGHT), (S.headcount_component(F.col("growth")), S.HEADCOUNT_WEIGHT)])
    return facts.select("id", score.alias("score"), S.why(F.col("recent"), F.col("ratio"), F.col("days"), F.col("growth")).alias("why"))


FACTS = f"""{SNAP}, {WIN}, {HCQ}, facts as (select s.id, recent, {RATIO} as ratio, case when latest is not null then greatest({D} - latest, 0) end as days, case when base_mid <> 0 then (recent_mid - base_mid) / base_mid end as growth
 from shown s left join win using (id) left join (select company_id as id, max(announced_date) as latest from rounds group by 1) l using (id) left join latest using (id) left join base using (id)),
 parts as (select *, ln(ratio * 4) / (2 * ln(4.0)) as a, exp(-days / 180.0) as b, case when growth is not null then least(greatest(0.5 + growth / 2, 0), 1) end as c from facts)"""
SCORE = "(coalesce(a * 0.5, 0) + coalesce(b * 0.35, 0) + coalesce(c * 0.15, 0)) / nullif((case when a is null then 0 else 0.5 end) + (case when b is null then 0 else 0.35 end) + (case when c is null then 0 else 0.15 end), 0)"
q("G6_company_score", lambda t: momentum(t).select("id", F.round("score", 6).alias("score")), f"with {FACTS} select id, round({SCORE}, 6) as score from parts")
q("G4_combine", lambda t: momentum(t).groupBy(F.col("score").isNull().alias("absent")).agg(F.count("*").alias("n")), f"with {FACTS} select {SCORE} is null as absent, count(*) as n from parts group by 1")
q("G5_why", lambda t: momentum(t).select("id", F.array_join("why", " · ").alias("why")),
  f"""with {FACTS} select id, array_to_string(list_filter([case when recent is not null and ratio >= 1.5 then 'news +' || cast(round_even((ratio - 1) * 100, 0) as bigint) || '%' when recent is not null and ratio is not null then cast(round_even(recent, 0) as bigint) || ' news mentions' end,
 case when days < 7 then 'raised this week' when days < 90 then 'raised ' || cast(round_even(days / 7, 0) as bigint) || case when round_even(days / 7, 0) = 1 then 'wk ago' else 'wks ago' end when days is not null then 'raised ' || cast(round_even(days / 30, 0) as bigint) || 'mo ago' end,
 case when round_even(growth * 100, 0) > 0 then '+' || cast(round_even(growth * 100, 0) as bigint) || '% team' when round_even(growth * 100, 0) < 0 then cast(round_even(growth * 100, 0) as bigint) || '% team' end], lambda x: x is not null), ' · ') as why from parts""")
PRESENT = {"website": "website is not null", "description_short": "description_short is not null", "funding": "funding_round_count > 0", "location": "hq_country is not null", "industry_group": "industry_group is not null", "people": "id % 2 = 0", "logo_url": "logo_url is not null", "tags": "id % 3 = 1", "employees": "employee_count_min is not null"}
q("G7_completeness", lambda t: t.shown.select("id", S.completeness({k: F.expr(e) for k, e in PRESENT.items()}).alias("score")),
  "select id, round(" + " + ".join(f"case when {PRESENT[k]} then {w} else 0 end" for k, w in S.COMPLETENESS.items()) + ", 4) as score from shown")
q("H16_completeness_clear", lambda t: t.counted.select("id", F.when(F.expr("exclusion_reason is null and (description_short is not null or funding_round_count > 0)"), S.completeness({k: F.expr(e) for k, e in PRESENT.items()})).alias("score")),
  "select id, case when exclusion_reason is null and (description_short is not null or funding_round_count > 0) then round(" + " + ".join(f"case when {PRESENT[k]} then {w} else 0 end" for k, w in S.COMPLETENESS.items()) + ", 4) end as score from counted")


def spotlight(t):
    r = t.rounds.where((F.col("announced_date") >= F.date_sub(day(), 90)) & (F.col("announced_date") <= day()))
    return S.spotlight(r, news(t).where(F.col("published_date") >= F.date_sub(day(), 30)), t.companies.where(F.col("created_at") >= F.date_sub(day(), 30)).select(F.col("id").alias("company_id")), AS_OF)


SPOT = f"""{NEWS}, f as (select company_id, max(3.0 * greatest(1 - greatest({D} - announced_date, 0) / 90.0, 0) + case when amount_raised > 0 then log10(cast(amount_raised as double)) / 3.0 else 0 end) as funding, max(announced_date) as latest from rounds where announced_date >= {D} - 90 and announced_date <= {D} group by 1),
 a as (select company_id, count(*) as articles from news where published_date >= {D} - 30 group by 1), n as (select id as company_id from companies where created_at >= {D} - 30), ids as (select company_id from f union select company_id from a union select company_id from n),
 spot as (select company_id, coalesce(funding, 0) + 0.5 * least(coalesce(articles, 0), 10) + case when n.company_id is not null then 1.5 else 0 end as score, latest from ids left join f using (company_id) left join a using (company_id) left join n using (company_id))"""
q("G8_spotlight", lambda t: spotlight(t).select("company_id", F.round("score", 6).alias("score"), "latest"), f"with {SPOT} select company_id, round(score, 6) as score, latest from spot")
q("G9_spotlight_pool", lambda t: spotlight(t).join(t.shown.select(F.col("id").alias("company_id"), "website"), "company_id").where("website is not null").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc_nulls_last("latest"), "company_id").limit(10).select("company_id", "score"),
  f"with {SPOT} select company_id, round(score, 6) as score from spot join shown s on s.id = company_id where website is not null order by round(score, 6) desc, latest desc nulls last, company_id limit 10")
q("G10_trending", lambda t: spotlight(t).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "company_id").limit(5).select("company_id"), f"with {SPOT} select company_id from spot order by round(score, 6) desc, company_id limit 5")
q("L5_heating_up", lambda t: momentum(t).withColumn("score", F.round("score", 6)).where("score >= 0.55").orderBy(F.desc("score"), "id").limit(12).select("id", "score"), f"with {FACTS} select id, round({SCORE}, 6) as score from parts where round({SCORE}, 6) >= 0.55 order by 2 desc, id limit 12")
q("J40_industry_rank", lambda t: (lambda m: t.shown.where("industry_group is not null").groupBy("industry_group").agg(F.count("*").alias("n")).join(m, "industry_group", "left").select("industry_group", "n", F.coalesce("heat", F.lit(0.0)).alias("heat")).orderBy(F.desc("heat"), F.desc("n"), "industry_group"))(
    momentum(t).join(t.companies.select("id", "industry_group"), "id").groupBy("industry_group").agg(F.round(F.avg("score"), 5).alias("heat"))),
  f"with {FACTS} select industry_group, count(*) as n, coalesce(round(avg({SCORE}), 5), 0) as heat from parts join shown s using (id) where industry_group is not null group by 1")
q("G11_edges", lambda t: G.competitor_edges(t.competitors), "select company_id, competitor_company_id, round(1.0 / min(rank), 3) as score from competitors where competitor_company_id is not null group by 1, 2")
q("J9_related_top", lambda t: G.competitor_edges(t.competitors).where("company_id = 11").join(t.companies.select(F.col("id").alias("competitor_company_id"), "slug"), "competitor_company_id").orderBy(F.desc("score"), "competitor_company_id").limit(12).select("slug", "score"),
  "select slug, round(1.0 / min(rank), 3) as score from competitors join companies c on c.id = competitor_company_id where company_id = 11 group by slug, competitor_company_id")
PATHS = "paths as (select investor_id, company_id from company_links union all select investor_id, company_id from links join rounds r on round_id = r.id)"


def paths(t):
    return t.company_links.select("investor_id", "company_id").unionByName(t.links.join(t.rounds.select(F.col("id").alias("round_id"), "company_id"), "round_id").select("investor_id", "company_id"))


q("J11_shared_backers", lambda t: G.also_backed_by(paths(t), 7, 640), f"with {PATHS}, own as (select distinct investor_id from paths where company_id = 7), low as (select investor_id from paths where investor_id in (select investor_id from own) group by 1 having count(*) <= 640) select company_id, count(distinct investor_id) as shared from paths where investor_id in (select investor_id from low) and company_id <> 7 group by 1 order by 2 desc, 1 limit 8")
q("J12_co_investors", lambda t: G.co_investors(t.links, 5), "select investor_id, count(distinct round_id) as rounds from links where investor_id <> 5 and round_id in (select round_id from links where investor_id = 5) group by 1 order by 2 desc, 1 limit 8")


# vectors
def embeddings(t):
    return t.raw("embeddings")


COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[]))"
q("L12_similar_rows", lambda t: V.nearest(embeddings(t).where("vec_id <> 3"), embeddings(t).where("vec_id = 3"), 6).select("vec_id", F.round("score", 6).alias("score")), f"select e.vec_id, round({COS}, 6) as score from embeddings e, embeddings s where s.vec_id = 3 and e.vec_id <> 3 order by {COS} desc, 1 limit 6")
q("L13_semantic_rows", lambda t: V.nearest(embeddings(t).where("label <> 2"), embeddings(t).where("vec_id = 9"), 30).select("vec_id", F.round("score", 6).alias("score")), f"select e.vec_id, round({COS}, 6) as score from embeddings e, embeddings s where s.vec_id = 9 and e.label <> 2 order by {COS} desc, 1 limit 30")
q("L14_hybrid_extras", lambda t: (lambda lex: V.nearest(embeddings(t).join(lex, "vec_id", "left_anti"), embeddings(t).where("vec_id = 9"), 10).select("vec_id", F.lit(1).alias("src")).unionByName(lex.orderBy("vec_id").limit(5).select("vec_id", F.lit(0).alias("src"))))(embeddings(t).where("label = 4").select("vec_id")),
  f"(select e.vec_id, 1 as src from embeddings e, embeddings s where s.vec_id = 9 and e.label <> 4 order by {COS} desc, 1 limit 10) union all (select vec_id, 0 from embeddings where label = 4 order by vec_id limit 5)")
q("U3_lexical_then_semantic", lambda t: (lambda lex: lex.withColumn("src", F.lit(0)).unionByName(V.nearest(embeddings(t), embeddings(t).where("vec_id = 1"), 20).join(lex, "vec_id", "left_anti").select("vec_id", F.lit(1).alias("src"))).orderBy("src", "vec_id").limit(24))(embeddings(t).where("label = 0 and vec_id < 100").select("vec_id")),
  f"with lex as (select vec_id, 0 as src from embeddings where label = 0 and vec_id < 100), sem as (select e.vec_id from embeddings e, embeddings s where s.vec_id = 1 order by {COS} desc, 1 limit 20) select * from (select vec_id, src from lex union all select vec_id, 1 from sem where vec_id not in (select vec_id from lex)) order by src, vec_id limit 24")
q("G14_cosine", lambda t: embeddings(t).crossJoin(F.broadcast(embeddings(t).where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("score")), f"select e.vec_id, round({COS}, 6) as score from embeddings e, embeddings s where s.vec_id = 0")
q("G12_unit_normalize", lambda t: embeddings(t).select("vec_id", F.posexplode(V.unit("embedding")).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("x")),
  "select vec_id, cast(place - 1 as int) as place, round(cast(embedding[place] as double) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as x from embeddings, range(1, 65) r(place)")


def centroids(t):
    parts = embeddings(t).select("label", F.posexplode(V.unit("embedding")).alias("place", "x"))
    mean = parts.groupBy("label", "place").agg(F.avg("x").alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean")).select("label", V.unit("mean").alias("centroid"))


CENT = "u as (select label, place, cast(embedding[place] as double) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as x from embeddings, range(1, 65) r(place)), m as (select label, place, avg(x) as x from u group by 1, 2), cent as (select label, place, x / sqrt(sum(x * x) over (partition by label)) as x from m)"
q("G13_centroids", lambda t: centroids(t).select("label", F.posexplode("centroid").alias("place", "x")).select("label", "place", F.round("x", 5).alias("x")), f"with {CENT} select label, cast(place - 1 as int) as place, round(x, 5) as x from cent")
q("G17_cluster_order", lambda t: (lambda s: W.first_per(s.withColumn("similarity", F.round("similarity", 5)), ["label"], [F.desc("similarity"), F.asc("vec_id")], 5).select("label", "vec_id", "similarity"))(embeddings(t).join(F.broadcast(centroids(t)), "label").select("label", "vec_id", V.cosine("embedding", "centroid").alias("similarity"))),
  f"with {CENT}, c as (select label, list(x order by place) as centroid from cent group by 1), s as (select e.label, vec_id, round(list_cosine_similarity(cast(embedding as double[]), centroid), 5) as similarity from embeddings e join c on e.label = c.label) select label, vec_id, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) as n from s) where n <= 5")
q("G15_choose_k", lambda t: embeddings(t).groupBy("label").agg(F.count("*").alias("n")).select("label", F.least(F.greatest(F.bround(F.sqrt(F.col("n") / 2)), F.lit(2)), F.lit(10)).cast("int").alias("k")), "select label, cast(least(greatest(round_even(sqrt(count(*) / 2.0), 0), 2), 10) as int) as k from embeddings group by 1")
# trigram joins
TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
NAMES = "names as (select p_partkey as id, p_name || ' ' || p_brand as name, " + TRI.format("p_name || ' ' || p_brand") + " as g from part)"


def names(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))


PAIRS = f"{NAMES}, grams as (select id, len(g) as n, unnest(g) as gram from names), pairs as (select a.id as left_id, b.id as right_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as similarity from grams a join grams b on a.gram = b.gram and a.id <> b.id group by 1, 2)"
q("T7_trigram_similarity", lambda t: names(t).crossJoin(F.broadcast(t.spark.createDataFrame([("lemon small Brand#12",)], "probe string"))).select("id", F.round(V.trigram_similarity(F.col("name"), F.col("probe")), 6).alias("similarity")),
  "with " + NAMES + ", p as (select " + TRI.format("'lemon small Brand#12'") + " as h) select id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) as similarity from names, p")
q("J19_fuzzy_pairs", lambda t: (lambda n: V.fuzzy_pairs(n, n, 0.45, distinct_order=True, digits=6))(names(t)), f"with {PAIRS} select left_id, right_id, round(similarity, 6) as similarity from pairs where similarity >= 0.45 and left_id < right_id")
q("J20_best_match", lambda t: (lambda n: V.best_alike(n, n, 0.45, 0.08).select("left_id", "right_id"))(names(t)), f"with {PAIRS}, r as (select *, row_number() over w as n, lead(similarity) over w as next from pairs where similarity >= 0.45 window w as (partition by left_id order by similarity desc, right_id)) select left_id, right_id from r where n = 1 and (next is null or similarity - next >= 0.08)")
q("J21_find_one", lambda t: (lambda n: V.closest(n.where("length(name) >= 6"), n, 0.6, 1, digits=6).select("left_id", F.expr("found[0].right_id as found")))(names(t)), f"with {PAIRS} select left_id, right_id as found from (select *, row_number() over (partition by left_id order by round(similarity, 6) desc, right_id) as n from pairs where similarity >= 0.6) where n = 1")
