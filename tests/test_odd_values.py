"""Odd values where Spark's functions and SQL's part ways."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathomline.functions import names as N

TITLES = [
    "Acme raises 5 million -  and more", "Acme | Wire\n", "Big -   ", "Acme raises \x0b- Wire", "Raise $5 bné of $7m İst's", "A - Aß's K", "Acme raises $10bn - Reuters", "x \n-\n Wire\n\n", "Acme - Wire",
    "Acme - and " + "a" * 50, "Acme – the end", "Acme —  it  is", "é5 billion 6 billionä _7 million", "5\x0bbillion", "", "Acme - " + "b" * 40 + "\n", "Acme - Aſ it", "$5 m",
]
LINES = ["0997 first\nsecond", "00", " 　 first \nx", "\t\nfirst", "\n \n01 \n", "", "1\n0", "10", None]


def both(spark, tmp_path, query, texts):
    place = tmp_path / "documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(place))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{place}/*.parquet'")
    got = sorted(map(tuple, entry.queries()[query](spark, str(tmp_path)).collect()))
    return got, sorted(con.execute(entry.oracle_sql()[query]).fetchall())


@pytest.mark.parametrize("query, texts", [("T44_title_signature", TITLES), ("H34_first_line", LINES)])
def test_against_sql(spark, tmp_path, query, texts):
    got, want = both(spark, tmp_path, query, texts)
    assert got == want


@pytest.mark.parametrize("amount, want", [("198500.00", "$198K"), ("199500.00", "$200K"), ("604500", "$604K"), ("12350000000", "$12.3B"), ("1250000", "$1.2M"), ("1350000", "$1.4M"), ("2.5", "$2"), ("3.50", "$4"), ("100500000", "$100M"), ("999999.99", "$1000K"), ("-1", "an undisclosed amount")])
def test_claims_round_as_python_prints(spark, amount, want):
    x = float(amount)
    python = "an undisclosed amount" if x < 0 else f"${x / 1e9:.1f}B" if x >= 1e9 else f"${x / 1e6:.0f}M" if x >= 1e8 else f"${x / 1e6:.1f}M" if x >= 1e6 else f"${x / 1e3:.0f}K" if x >= 1e3 else f"${x:.0f}"
    got = spark.range(1).select(N.claim_usd(F.lit(amount).cast("decimal(20,2)")).alias("x")).first().x
    assert got == python == want


def test_articles_after_empty_texts(spark, tmp_path):
    place = tmp_path / "documents.parquet"
    texts = [None, "", "   ", ". ", "Acme Wire raises. Acme Wire is big. More", "\t"]
    rows = [(n, texts[n % len(texts)], "src0") for n in [*range(-20, 60), *range(3, 50, 7)]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(place))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{place}/*.parquet'")
    columns = ["doc_id", "attach", "reason", "other_entity"]
    got = [tuple(r) for r in entry.queries()["Z20_distrusted_articles"](spark, str(tmp_path)).select(*columns).collect()]
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['Z20_distrusted_articles']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 79
