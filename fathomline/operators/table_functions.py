"""Table functions for SQL: nearest companies, funding by quarter, the momentum of industries and each company's quarters.

``register`` makes them temporary functions over the caller's tables, so that ``spark.sql`` and lateral joins can use
them; their bodies are SQL that the optimiser sees through. ``quarter_walk`` takes a table argument that the
caller partitions and orders, and keeps one quarter at a time, in Python; ``quarters_by_company`` gives the same of the rounds themselves.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DateType, DecimalType, IntegerType, StructType

COMPANIES, ROUNDS = "fathomline_companies", "fathomline_rounds"
SHOWN = "exclusion_reason is null and (description_short is not null or funding_round_count > 0)"
DOT = "aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0d, (s, x) -> s + x)"
NORM = f"sqrt({DOT.format(a='{a}', b='{a}')})"
COSINE = f"try_divide({DOT}, {{m}} * {{n}})"

FUNCTIONS = [
    f"""create or replace temporary function similar_companies(p_company_id bigint, p_match_count int default 6)
returns table (id bigint, slug string, name string, logo_url string, description_short string, industry_group string, similarity double)
return select m.id, m.slug, m.name, m.logo_url, m.description_short, m.industry_group, m.similarity from (
 select *, row_number() over (order by similarity desc nulls last, id) as n from (
  select c.id, c.slug, c.name, c.logo_url, c.description_short, c.industry_group, {COSINE.format(a="c.embedding", b="s.embedding", m="c.norm", n="s.norm")} as similarity
  from {COMPANIES} c join (select embedding, norm from {COMPANIES} where id = similar_companies.p_company_id and embedding is not null) s
    on c.id <> similar_companies.p_company_id and c.embedding is not null and c.exclusion_reason is null)) m where m.n <= similar_companies.p_match_count""",
    f"""create or replace temporary function semantic_companies(p_query array<float>, p_match_count int default 30)
returns table (id bigint, slug string, name string, industry_group string, description_short string, status string, logo_url string, similarity double)
return select m.id, m.slug, m.name, m.industry_group, m.description_short, m.status, m.logo_url, m.similarity from (
 select *, row_number() over (order by similarity desc nulls last, id) as n from (
  select c.*, {COSINE.format(a="c.embedding", b="semantic_companies.p_query", m="c.norm", n=NORM.format(a="semantic_companies.p_query"))} as similarity from {COMPANIES} c where embedding is not null and {SHOWN})) m
where m.n <= semantic_companies.p_match_count""",
    f"""create or replace temporary function funding_by_quarter(p_quarters int, p_industry_group string default null, p_as_of date default current_date())
returns table (quarter_start date, total_usd decimal(38,2), round_count int)
return select cast(date_trunc('quarter', r.announced_date) as date), sum(r.amount_raised), cast(count(*) as int)
 from {ROUNDS} r join {COMPANIES} c on c.id = r.company_id
 where {SHOWN} and r.amount_raised is not null
  and r.announced_date >= add_months(trunc(funding_by_quarter.p_as_of, 'quarter'), -3 * (funding_by_quarter.p_quarters - 1))
  and (funding_by_quarter.p_industry_group is null or c.industry_group = funding_by_quarter.p_industry_group) group by 1""",
    f"""create or replace temporary function industry_funding_momentum(p_as_of date default current_date())
returns table (industry_group string, recent_usd decimal(38,2), prior_usd decimal(38,2), round_count int)
return select x.industry_group, sum(x.amount_raised) filter (where x.recent), sum(x.amount_raised) filter (where not x.recent), cast(count_if(x.recent) as int) from (
 select c.industry_group, r.amount_raised, r.announced_date >= add_months(trunc(industry_funding_momentum.p_as_of, 'quarter'), -6) as recent
 from {ROUNDS} r join {COMPANIES} c on c.id = r.company_id
 where {SHOWN} and c.industry_group is not null and r.amount_raised is not null
  and r.announced_date >= add_months(trunc(industry_funding_momentum.p_as_of, 'quarter'), -12)
  and r.announced_date < trunc(industry_funding_momentum.p_as_of, 'quarter')) x group by 1""",
    # quarters with rounds meet in one window; each then gives the quiet ones up to the next
    f"""create or replace temporary function quarters_by_company()
returns table (company_id bigint, quarter_start date, rounds int, total decimal(38,2), running_total decimal(38,2), quiet_quarters int)
return select w.company_id, cast(add_months(w.q, 3 * w.quiet) as date), cast(if(w.quiet = 0, w.n, 0) as int), cast(if(w.quiet = 0, w.total, 0) as decimal(38,2)), cast(w.running as decimal(38,2)), w.quiet from (
 select company_id, q, n, total, running, explode(sequence(0, coalesce(4 * (year(following) - year(q)) + quarter(following) - quarter(q), 1) - 1)) as quiet from (
  select company_id, q, n, total, sum(total) over (partition by company_id order by q rows unbounded preceding) as running, lead(q) over (partition by company_id order by q) as following from (
   select company_id, trunc(announced_date, 'quarter') as q, count(*) as n, coalesce(sum(amount_raised), 0) as total from {ROUNDS} where announced_date is not null group by 1, 2))) w""",
]


@udtf
class QuarterWalk:
    """One row a quarter of a partition from its first round to its last, quarters without rounds included.

    The table argument has a group, a date and an amount, in this order; ``partition by`` the group and ``order by`` the date.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        fields = rows.dataType.fields
        if not rows.isTable or len(fields) != 3:
            raise ValueError("quarter_walk takes a table of a group, a date and an amount")
        money = DecimalType(38, 2)
        return AnalyzeResult(StructType().add("grp", fields[0].dataType).add("quarter_start", DateType()).add("rounds", IntegerType()).add("total", money).add("running_total", money).add("quiet_quarters", IntegerType()))

    def __init__(self):
        self.at, self.group, self.rounds, self.quiet = None, None, 0, 0
        self.total = self.running = Decimal(0)

    def _row(self):
        self.running += self.total
        self.quiet = 0 if self.rounds else self.quiet + 1
        out = (self.group, date(self.at // 4, self.at % 4 * 3 + 1, 1), self.rounds, self.total, self.running, self.quiet)
        self.at, self.rounds, self.total = self.at + 1, 0, Decimal(0)
        return out

    def eval(self, row):
        group, day, amount = row[0], row[1], row[2]
        if day is None:
            return
        quarter = day.year * 4 + (day.month - 1) // 3
        if self.at is None:
            self.at, self.group = quarter, group
        while self.at < quarter:
            yield self._row()
        self.rounds += 1
        self.total += Decimal(0) if amount is None else Decimal(str(amount))

    def terminate(self):
        if self.at is not None:
            yield self._row()


def register(spark: SparkSession, companies: DataFrame, rounds: DataFrame) -> None:
    """Make the functions known to ``spark.sql`` over ``companies`` (with ``embedding`` and ``funding_round_count``) and ``rounds``."""
    # a row's norm once, not once a pair
    companies.withColumn("norm", F.expr(NORM.format(a="embedding"))).createOrReplaceTempView(COMPANIES)
    rounds.createOrReplaceTempView(ROUNDS)
    for body in FUNCTIONS:
        spark.sql(body)
    spark.udtf.register("quarter_walk", QuarterWalk)
