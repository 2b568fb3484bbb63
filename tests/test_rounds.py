import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fathomline.operators import rounds as R
from fathomline.operators.components import components

KINDS = {"Seed": "seed", "Series A": "series a", "undisclosed": None, None: None}
SURE = {"low": 0, "medium": 1, "high": 2, None: None}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "company_id long, id long, amount double, round_type string, announced_date date, confidence string")
    return df.withColumn("amount_raised", F.col("amount").cast("decimal(20,2)")).drop("amount")


def links(spark, backers):
    return spark.createDataFrame([(i, b) for i, bs in backers.items() for b in bs] or [(-1, -1)], "round_id long, investor_id long")


def greedy(rows, backers):
    """The merge as a loop over each company's rows."""
    out = []
    for company in {r[0] for r in rows}:
        own = [{"id": r[1], "amount": r[2], "kind": KINDS[r[3]], "day": r[4], "sure": SURE[r[5]], "b": set(backers.get(r[1], ()))} for r in rows if r[0] == company and r[2] is not None]
        own.sort(key=lambda x: (x["kind"] is None, x["day"] is None, 1 if x["sure"] is None else -x["sure"], x["id"]))
        gone = set()

        def match(a, b):
            share = lambda low, high: a["amount"] != b["amount"] and max(a["amount"], b["amount"]) > 0 and low < (max(a["amount"], b["amount"]) - min(a["amount"], b["amount"])) / max(a["amount"], b["amount"]) <= high
            if not share(0, 0.15) and not (share(0.15, 0.25) and len(a["b"] & b["b"]) >= 2):
                return False
            if a["kind"] and b["kind"] and a["kind"] != b["kind"]:
                return False
            if a["day"] is None or b["day"] is None:
                return not (a["day"] is None and b["day"] is None)
            return abs((a["day"] - b["day"]).days) <= 14

        for n, a in enumerate(own):
            more = a["id"] not in gone
            while more:
                more = False
                for b in own[n + 1 :]:
                    if b["id"] not in gone and match(a, b):
                        gone.add(b["id"])
                        a["b"] |= b["b"]
                        out.append((b["id"], a["id"]))
                        more = True
    return sorted(out)


def made(rng, n, companies, days, amounts):
    rows = []
    for i in range(n):
        day = None if rng.random() < 0.2 else date(2020, 1, 1) + timedelta(rng.randint(0, days))
        rows.append((rng.randint(1, companies), i, None if rng.random() < 0.1 else float(amounts(rng)), rng.choice(list(KINDS)), day, rng.choice(list(SURE))))
    return rows, {i: rng.sample(range(6), rng.randint(0, 4)) for i in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_near_amounts_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows, backers = made(rng, 260, 4, 80, lambda r: r.choice([0, -5, 10, 11, 12.5, 13, 15, 16, 18, 20, 24, 30, 1e9, 1.2e9]))
    got = sorted(map(tuple, R.collapse_near_amounts(frame(spark, rows), links(spark, backers)).collect()))
    assert got == greedy(rows, backers) and got


def test_cases_of_near_amounts(spark):
    d = date(2024, 5, 1)
    cases = {  # company: rows of amount, type, day, backers; which of them stay
        1: ([(100, "Seed", d, ""), (115, "Seed", d, "")], [0]), 2: ([(100, "Seed", d, ""), (120, "Seed", d, "")], [0, 1]),
        3: ([(100, "Seed", d, "ab"), (120, "Seed", d, "abc")], [0]), 4: ([(100, "Seed", d, "a"), (120, "Seed", d, "ab")], [0, 1]),
        5: ([(100, "Seed", d, ""), (105, "Series A", d, "")], [0, 1]), 6: ([(100, "Seed", d, ""), (105, None, None, "")], [0]),
        7: ([(100, "Seed", None, ""), (105, "Seed", None, "")], [0, 1]), 8: ([(100, "Seed", d, ""), (105, "Seed", d + timedelta(14), ""), (105.5, "Seed", d + timedelta(15), "")], [0, 2]),
        9: ([(100, "Seed", d, "a"), (124, "Seed", d, "ab"), (110, "Seed", d, "b")], [0]),  # the third brings what the second shares
        10: ([(100, "Seed", d, ""), (114, "Seed", d, ""), (130, "Seed", d, "")], [0, 2]),  # never through another row
    }
    rows, backers, want = [], {}, set()
    for c, (own, stay) in cases.items():
        for n, (amount, kind, day, b) in enumerate(own):
            rows.append((c, c * 10 + n, float(amount), kind, day, "high"))
            backers[c * 10 + n] = [ord(x) for x in b]
        want |= {c * 10 + n for n in range(len(own)) if n not in stay}
    assert {r.loser for r in R.collapse_near_amounts(frame(spark, rows), links(spark, backers)).collect()} == want


def reconciled(rows):
    out = []
    for company in {r[0] for r in rows}:
        made = []
        for _, i, amount, kind, day, _ in sorted((r for r in rows if r[0] == company), key=lambda r: r[1]):
            kind = KINDS[kind]
            hit = None
            if kind is not None or day is not None:
                hit = next((m for m in made if m["kind"] == kind and (m["day"] is None) == (day is None) and (day is None or abs((m["day"] - day).days) <= 60)), None)
            if hit is None and amount is not None:
                hit = next((m for m in made if m["amount"] == amount and (m["kind"] is None or kind is None or m["kind"] == kind)), None)
            out.append((i, i if hit is None else hit["id"], hit is None))
            if hit is None:
                made.append({"id": i, "kind": kind, "day": day, "amount": amount})
            else:
                hit["kind"], hit["day"] = hit["kind"] or kind, hit["day"] or day
                hit["amount"] = hit["amount"] if hit["amount"] is not None else amount
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_reconciliation_against_a_loop(spark, seed):
    rows, _ = made(random.Random(seed), 300, 5, 900, lambda r: r.randint(1, 12))
    assert sorted(map(tuple, R.reconcile(frame(spark, rows)).collect())) == reconciled(rows)


def test_a_company_of_a_hundred_thousand_rounds(spark):
    """One company's rounds pass in bounded time; the components are small though the company isn't."""
    n = 100_000
    df = spark.range(n).selectExpr("1L as company_id", "id", "cast(exp(pmod(hash(id, 7), 1000000) / 1e6 * 14) * 1000 as decimal(20,2)) as amount_raised", "case pmod(hash(id), 4) when 0 then 'Seed' when 1 then 'Series A' when 2 then 'Series B' end as round_type",
                                  "date '1950-01-01' + pmod(hash(id, 3), 27000) as announced_date", "'high' as confidence")
    out = R.collapse_near_amounts(df, spark.createDataFrame([(1, 1)], "round_id long, investor_id long"))
    rows = out.collect()
    losers = {r.loser for r in rows}
    assert 1000 < len(rows) < n / 2 and len(losers) == len(rows) and not losers & {r.survivor for r in rows}
    again = R.reconcile(df)
    assert again.count() == n and again.where("created").count() < n


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
