from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import similarity
from fathomline.operators.table_functions import register
from fathomline.plans.registry import queries


@pytest.fixture
def sql(spark):
    columns = "id long, slug string, name string, logo_url string, description_short string, industry_group string, status string, exclusion_reason string, funding_round_count long, embedding array<float>"
    c = [
        (1, "a", "A", None, "d", "x", "active", None, 0, [1.0, 0.0]), (2, "b", "B", None, None, "x", "active", None, 1, [1.0, 1.0]), (3, "c", "C", None, None, "y", None, None, 0, [1.0, 0.1]),
        (4, "d", "D", None, "d", "y", None, "manual", 3, [1.0, 0.0]), (5, "e", "E", None, "d", None, None, None, 1, None), (6, "f", "F", None, "d", "y", None, None, 2, [0.0, 0.0]),
    ]
    r = [(1, date(2024, 5, 1), 10), (1, date(2024, 7, 2), 5), (2, date(2023, 12, 31), 7), (2, date(2024, 8, 1), None), (4, date(2024, 5, 1), 100), (6, None, 3), (6, date(2024, 7, 1), 1), (6, date(2023, 7, 1), 2), (3, date(2024, 5, 1), 50), (5, date(2024, 5, 1), 4)]
    register(spark, spark.createDataFrame(c, columns), spark.createDataFrame(r, "company_id long, announced_date date, amount_raised long").withColumn("amount_raised", F.col("amount_raised").cast("decimal(20,2)")))
    return lambda text: [tuple(x) for x in spark.sql(text).collect()]


def test_nearest_companies(sql):
    assert sql("select id, round(similarity, 3) from similar_companies(1, 3)") == [(3, 0.995), (2, 0.707), (6, None)]
    assert sql("select id from similar_companies(5)") == [] == sql("select id from similar_companies(99)")
    assert sql("select slug, round(similarity, 3) from semantic_companies(array(1f, 0f), 2)") == [("a", 1.0), ("b", 0.707)]
    assert sql("select q.i, s.id from values (1), (2) q(i), lateral similar_companies(q.i, 1) s order by 1") == [(1, 3), (2, 3)]


def test_funding(sql):
    assert [(d, int(t), n) for d, t, n in sql("select * from funding_by_quarter(3, p_as_of => date '2024-08-15') order by 1")] == [(date(2024, 4, 1), 14, 2), (date(2024, 7, 1), 6, 2)]
    assert [(d, int(t)) for d, t, _ in sql("select * from funding_by_quarter(8, 'x', date '2024-08-15') order by 1")] == [(date(2023, 10, 1), 7), (date(2024, 4, 1), 10), (date(2024, 7, 1), 5)]
    assert [(g, a and int(a), b and int(b), n) for g, a, b, n in sql("select * from industry_funding_momentum(date '2024-08-15') order by 1")] == [("x", 10, 7, 1), ("y", None, 2, 0)]


def test_quarter_walk(sql):
    got = sql("select * from quarter_walk(table(select company_id, announced_date, amount_raised from fathomline_rounds) partition by company_id order by announced_date) where grp in (1, 2, 6) order by 1, 2")
    assert [(g, str(d), n, int(t), int(r), quiet) for g, d, n, t, r, quiet in got] == [
        (1, "2024-04-01", 1, 10, 10, 0), (1, "2024-07-01", 1, 5, 15, 0), (2, "2023-10-01", 1, 7, 7, 0), (2, "2024-01-01", 0, 0, 7, 1), (2, "2024-04-01", 0, 0, 7, 2), (2, "2024-07-01", 1, 0, 7, 0),
        (6, "2023-07-01", 1, 2, 2, 0), (6, "2023-10-01", 0, 0, 2, 1), (6, "2024-01-01", 0, 0, 2, 2), (6, "2024-04-01", 0, 0, 2, 3), (6, "2024-07-01", 1, 1, 3, 0),
    ]


def test_quarters_by_company_are_the_walk_without_python(spark, sql):
    walk = sql("select * from quarter_walk(table(select company_id, announced_date, amount_raised from fathomline_rounds) partition by company_id order by announced_date)")
    assert sorted(sql("select * from quarters_by_company()")) == sorted(walk) and len(walk) == 14
    plan = queries()["E1_quarter_walk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDTF" not in plan


@pytest.mark.parametrize("query", ["E1_similar_companies", "E1_semantic_companies"])
def test_many_companies_asked_at_once_write_no_pairs(spark, query):
    plan = queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_nearest_each_is_the_lateral_join(spark, monkeypatch):
    monkeypatch.setattr(similarity, "VECTORS", 7)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    odd = [[0.0, 0.0, 0.0], [nan, 1.0, 0.0], [inf, 0.0, 1.0], [1.0, None, 2.0], [1.0, 2.0], [], [1e-30, 1e-30, 0.0], [-1.0, -2.0, -3.0], [1.0, 2.0, 3.0], None]
    vectors = [*odd, *rng.normal(size=(40, 3)).tolist(), *([[0.5, 0.25, -1.0]] * 30)]
    rows = [(n, f"s{n}", "N", None, "d", "x", "active", "manual" if n % 9 == 4 else None, 1, vectors[n * 7 % len(vectors)]) for n in range(160)]
    columns = "id long, slug string, name string, logo_url string, description_short string, industry_group string, status string, exclusion_reason string, funding_round_count long, embedding array<float>"
    register(spark, spark.createDataFrame(rows, columns), spark.createDataFrame([], "company_id long, announced_date date, amount_raised decimal(20,2)"))
    exact = lambda df: sorted((r[0], r[1], repr(r[2])) for r in df.collect())
    c = spark.table("fathomline_companies").select("id", "embedding", "exclusion_reason").where("embedding is not null")
    given = c.where("exclusion_reason is null").select("id", "embedding")
    asked = c.where("id % 3 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = exact(similarity.nearest_each(asked, given, 4, others=True))
    assert got == exact(spark.sql("select q.id, s.id, s.similarity from (select id from fathomline_companies where id % 3 = 0) q, lateral similar_companies(q.id, 4) s")) and len(got) > 150
    got = exact(similarity.nearest_each(asked.where("query_id < 60"), given, 5))
    assert got == exact(spark.sql("select q.id, s.id, s.similarity from (select id, embedding from fathomline_companies where id % 3 = 0 and id < 60 and embedding is not null) q, lateral semantic_companies(q.embedding, 5) s"))
    assert similarity.nearest_each(asked, given.where("id < 0"), 4).count() == 0 == similarity.nearest_each(asked.where("query_id < 0"), given, 4).count()
