"""Table functions called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import similarity as V
from fathomline.operators.table_functions import SHOWN, register
from fathomline.plans.aggregates import D
from fathomline.plans.registry import q
from fathomline.sources.tables import AS_OF


def sql(t, text):
    """``text`` with the functions over the bound tables; a company's vector is that of its id."""
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    register(t.spark, t.counted.join(vectors, "id", "left"), t.rounds)
    return t.spark.sql(text)


EMBEDDED = "e as (select c.*, v.embedding from counted c join embeddings v on v.vec_id = c.id where exclusion_reason is null)"
COS = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"
ORDER = f"row_number() over (partition by a.vec_id order by {COS} desc, b.id)"


def embedded(t, companies, key="id"):
    """``companies`` that have a vector, that of their id, with it."""
    vectors = t.raw("embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    return companies.join(vectors, "id").select(F.col("id").alias(key), "embedding")


# many companies asked at once: the rows of lateral joins with similar_companies and semantic_companies, without writing down pairs
q("E1_similar_companies", lambda t: V.nearest_each(embedded(t, t.companies.where("id % 100 = 0"), "query_id"), embedded(t, t.companies.where("exclusion_reason is null")), 4, others=True).join(t.companies, "id").select("query_id", "id", "slug", "industry_group", F.round("similarity", 6).alias("similarity")),
  f"with {EMBEDDED} select query_id, id, slug, industry_group, similarity from (select a.vec_id as query_id, b.id, b.slug, b.industry_group, round({COS}, 6) as similarity, {ORDER} as n from embeddings a join e b on b.id <> a.vec_id where a.vec_id % 100 = 0 and a.vec_id in (select id from companies)) where n <= 4")
q("E1_semantic_companies", lambda t: V.nearest_each(t.raw("embeddings").where("vec_id % 100 = 7").select(F.col("vec_id").alias("query_id"), "embedding"), embedded(t, t.counted.where(SHOWN)), 5).join(t.companies, "id").select("query_id", "id", "slug", "status", F.round("similarity", 6).alias("similarity")),
  f"with {EMBEDDED} select query_id, id, slug, status, similarity from (select a.vec_id as query_id, b.id, b.slug, b.status, round({COS}, 6) as similarity, {ORDER} as n from embeddings a, e b where a.vec_id % 100 = 7 and (description_short is not null or funding_round_count > 0)) where n <= 5")
q("E1_funding_by_quarter", lambda t: sql(t, f"select quarter_start, cast(total_usd as double) as total_usd, round_count, 'all' as grp from funding_by_quarter(12, p_as_of => date '{AS_OF}') union all select quarter_start, cast(total_usd as double), round_count, 'BUILDING' from funding_by_quarter(6, 'BUILDING', date '{AS_OF}')"),
  " union all ".join(f"select cast(date_trunc('quarter', announced_date) as date) as quarter_start, cast(sum(amount_raised) as double) as total_usd, cast(count(*) as int) as round_count, '{g}' as grp from rounds join shown s on s.id = company_id where amount_raised is not null and announced_date >= date_trunc('quarter', {D}) - interval {3 * (n - 1)} month and {w} group by 1" for g, n, w in (("all", 12, "true"), ("BUILDING", 6, "industry_group = 'BUILDING'"))))
HALF = f"date_trunc('quarter', {D}) - interval 6 month"
q("E1_industry_momentum", lambda t: sql(t, f"select industry_group, cast(recent_usd as double) as recent_usd, cast(prior_usd as double) as prior_usd, round_count from industry_funding_momentum(date '{AS_OF}')"),
  f"select industry_group, cast(sum(amount_raised) filter (where announced_date >= {HALF}) as double) as recent_usd, cast(sum(amount_raised) filter (where announced_date < {HALF}) as double) as prior_usd, cast(count(*) filter (where announced_date >= {HALF}) as int) as round_count from rounds join shown s on s.id = company_id where industry_group is not null and amount_raised is not null and announced_date >= date_trunc('quarter', {D}) - interval 12 month and announced_date < date_trunc('quarter', {D}) group by 1")
q("E1_quarter_walk", lambda t: sql(t, "select company_id, quarter_start, rounds, cast(total as double) as total, cast(running_total as double) as running_total, quiet_quarters from quarters_by_company()"),
  """with a as (select company_id, date_trunc('quarter', announced_date)::date as q, count(*) as n, coalesce(sum(amount_raised), 0) as s from rounds where announced_date is not null group by 1, 2),
 b as (select company_id, unnest(generate_series(min(q)::timestamp, max(q)::timestamp, interval 3 month))::date as q from a group by 1),
 c as (select company_id, b.q, coalesce(n, 0) as n, coalesce(s, 0) as s, max(case when n is not null then b.q end) over w as last, sum(coalesce(s, 0)) over w as r from b left join a using (company_id, q) window w as (partition by company_id order by b.q))
 select company_id, q as quarter_start, cast(n as int) as rounds, cast(s as double) as total, cast(r as double) as running_total, cast(datediff('quarter', last, q) as int) as quiet_quarters from c""")
