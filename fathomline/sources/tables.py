"""Entity tables bound to the star-schema Parquet files.

Each bound column is one expression in the common subset of Spark SQL and ANSI SQL, so the
same text makes the DataFrame here and the oracle's view. Synthetic columns are deterministic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"
ROUND_AMOUNT = "cast(case when o_orderkey % 13 = 0 then null else o_totalprice end as decimal(20,2))"

COMPANY = {
    "id": "c_custkey",
    "name": "c_name",
    "slug": "concat('co-', cast(c_custkey as string))",
    "industry_group": "case when c_custkey % 23 = 0 then null else c_mktsegment end",
    "hq_country": "n_name",
    "exclusion_reason": "case when c_custkey % 17 = 0 then 'manual' end",
    "description_short": "case when c_custkey % 5 = 0 then null else concat(c_mktsegment, ' maker no. ', cast(c_custkey % 40 as string)) end",
    "website": "case when c_custkey % 7 = 0 then null else concat('https://www.c', cast(c_custkey % 700 as string), '.example.com/') end",
    "logo_url": "case when c_custkey % 4 = 0 then null else 'logo' end",
    "employee_count_min": "case when c_custkey % 3 = 0 then null else (c_custkey % 50) * 10 end",
    "employee_count_max": "case when c_custkey % 3 = 0 then null else (c_custkey % 50) * 10 + 40 end",
    "created_at": "date '2001-07-31' - cast(c_custkey % 400 as int)",
    "checked_at": "case when c_custkey % 6 = 0 then null else date '2001-07-31' - cast(c_custkey % 120 as int) end",
    "status": "case when c_custkey % 29 = 0 then 'acquired' when c_custkey % 31 = 0 then null else 'active' end",
    "prompt_version": "case when c_custkey % 8 = 0 then null else concat('v', cast(c_custkey % 4 as string)) end",
    "total_raised_usd": "cast(case when c_custkey % 9 = 0 then null else c_acctbal * 100 end as decimal(20,2))",
}
ROUND = {
    "id": "o_orderkey",
    "company_id": "o_custkey",
    "amount_raised": ROUND_AMOUNT,
    "valuation": "cast(case when o_orderkey % 5 = 0 then o_totalprice * 4 end as decimal(20,2))",
    "announced_date": "case when o_orderkey % 19 = 0 then null else cast(o_orderdate as date) end",
    "round_type": "case when o_orderkey % 11 = 0 then null else o_orderpriority end",
    "confidence": "case o_orderkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end",
    "news_url": "case when o_orderkey % 4 = 0 then null else concat('https://news.example.com/', cast(o_orderkey % 900 as string)) end",
}
LINK = {"round_id": "l_orderkey", "investor_id": "l_suppkey", "is_lead": "l_linenumber = 1"}
INVESTOR = {"id": "s_suppkey", "name": "s_name", "slug": "concat('inv-', cast(s_suppkey as string))", "kind": "case when s_suppkey % 3 = 0 then 'angel' when s_suppkey % 3 = 1 then 'institutional' else 'unknown' end"}
COMPANY_LINK = {"company_id": "c_custkey", "investor_id": "c_custkey % 40 + 1", "is_lead": "c_custkey % 2 = 0"}
RUN = {"id": "event_id", "stage": "event_type", "started_at": "cast(ts as timestamp)", "status": "case when event_id % 10 = 0 then 'error' when event_id % 7 = 0 then 'empty' else 'success' end", "rows_written": "cast(floor(value) as bigint)"}
COMPETITOR = {
    "company_id": "c_custkey",
    "competitor_company_id": "case when c_custkey % 5 = 0 then null else c_custkey + 7 * k * (1 - 2 * (c_custkey % 2)) end",
    "competitor_name": "concat('Rival ', cast(c_custkey + 7 * k * (1 - 2 * (c_custkey % 2)) as string))",
    "rank": "k",
    "reasoning": "case when (c_custkey + k) % 37 = 0 then 'should be dropped: not a rival' else 'sells to the same buyers' end",
}

#: Oracle views, each over the driver's tables.
VIEWS = {
    "companies": "select {} from customer join nation on c_nationkey = n_nationkey",
    "rounds": "select {} from orders",
    "links": "select {} from lineitem",
    "investors": "select {} from supplier",
    "company_links": "select {} from customer where c_custkey % 3 <> 0",
    "runs": "select {} from events",
    "competitors": "select {} from customer, (values (1), (2), (3)) ks(k) where c_custkey + 7 * k * (1 - 2 * (c_custkey % 2)) > 0",
}
COLUMNS = {"companies": COMPANY, "rounds": ROUND, "links": LINK, "investors": INVESTOR, "company_links": COMPANY_LINK, "runs": RUN, "competitors": COMPETITOR}


def view_sql(name: str) -> str:
    return VIEWS[name].format(", ".join(f"{e} as {c}" for c, e in COLUMNS[name].items()))


def _bind(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in COLUMNS[name].items()])


class Tables:
    """The bound tables of one data folder; nothing is read that a query doesn't select."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        nation = F.broadcast(self.raw("nation"))  # 25 rows at any scale
        return _bind(self.raw("customer").join(nation, F.expr("c_nationkey = n_nationkey")), "companies")

    @cached_property
    def rounds(self) -> DataFrame:
        return _bind(self.raw("orders"), "rounds")

    @cached_property
    def links(self) -> DataFrame:
        return _bind(self.raw("lineitem"), "links")

    @cached_property
    def investors(self) -> DataFrame:
        return _bind(self.raw("supplier"), "investors")

    @cached_property
    def company_links(self) -> DataFrame:
        return _bind(self.raw("customer").where("c_custkey % 3 <> 0"), "company_links")

    @cached_property
    def runs(self) -> DataFrame:
        return _bind(self.raw("events"), "runs")

    @cached_property
    def competitors(self) -> DataFrame:
        ranked = self.raw("customer").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
        return _bind(ranked.where("c_custkey + 7 * k * (1 - 2 * (c_custkey % 2)) > 0"), "competitors")

    @cached_property
    def counted(self) -> DataFrame:
        """Companies with ``funding_round_count``."""
        n = self.rounds.groupBy(F.col("company_id").alias("cid")).agg(F.count("*").alias("n"))
        joined = self.companies.join(n, F.col("id") == F.col("cid"), "left")
        return joined.withColumn("funding_round_count", F.coalesce("n", F.lit(0))).drop("n", "cid")

    @cached_property
    def shown(self) -> DataFrame:
        from fathomline.operators.predicates import shown

        return self.counted.where(shown())


COUNTED_SQL = "select c.*, coalesce(n, 0) as funding_round_count from companies c left join (select company_id as cid, count(*) as n from rounds group by 1) on id = cid"
SHOWN_SQL = "select * from counted where exclusion_reason is null and (description_short is not null or funding_round_count > 0)"


def with_views(sql: str) -> str:
    """``sql`` with the views that it names, and those that these name, defined before it."""
    import re

    bodies = {n: view_sql(n) for n in VIEWS} | {"counted": COUNTED_SQL, "shown": SHOWN_SQL}
    order = [*VIEWS, "counted", "shown"]
    used: set[str] = set()

    def need(text: str) -> None:
        for n in order:
            if n not in used and re.search(rf"\b{n}\b", text):
                used.add(n)
                need(bodies[n])

    need(sql)
    ctes = ", ".join(f"{n} as ({bodies[n]})" for n in order if n in used)
    body = sql.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
