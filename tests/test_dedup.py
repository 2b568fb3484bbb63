import re
from datetime import date

import pytest

from fathomline.operators import dedup as D
from fathomline.plans.entities import doubled, judge
from fathomline.sources.tables import Tables

FILL = ["website", "hq_city", "hq_state", "description_long"]


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", name.lower()) if w for i in range(len(w) + 1)}


def rank(r):
    return (not r["description_long"], not r["website"], r["created_at"], r["id"])


def merged(rows, remap):
    out = {i: dict(r) for i, r in rows.items() if i not in remap}
    for loser in sorted(remap):
        for c in FILL:
            out[remap[loser]][c] = out[remap[loser]][c] if out[remap[loser]][c] is not None else rows[loser][c]
    return out


def ends(remap):
    def end(x):
        return end(remap[x]) if x in remap else x

    return {x: end(x) for x in remap}


def loop(rows, judge, most):
    """The driver as one loop over all rows and pairs."""
    domains, first = {}, {}
    for r in rows.values():
        found = re.match(r"https://www\.(d\d+\.example\.com)", r["website"] or "")
        if found:
            domains.setdefault(found[1], []).append(r)
    for group in domains.values():
        best = min(group, key=rank)
        first |= {r["id"]: best["id"] for r in group if r is not best}
    rows = merged(rows, first)
    g = {i: grams(r["name"]) for i, r in rows.items()}
    pairs = []
    for a in rows:
        for b in rows:
            if a < b:
                s = len(g[a] & g[b]) / max(1, len(g[a] | g[b]))
                here = rows[a]["hq_city"] is not None and rows[a]["hq_state"] is not None and (rows[a]["hq_city"], rows[a]["hq_state"]) == (rows[b]["hq_city"], rows[b]["hq_state"])
                if s >= 0.45 or (here and s >= 0.30):
                    pairs.append((-s, a, b))
    gone, second, seen = set(), {}, []
    for s, a, b in sorted(pairs)[:most]:
        if a in gone or b in gone:
            continue
        same = judge(rows[a], rows[b])
        seen.append((a, b, same))
        if same:
            survivor, loser = sorted((a, b), key=lambda i: rank(rows[i]))
            gone.add(loser)
            second[loser] = survivor
    second_ends = ends(second)
    return merged(rows, second_ends), ends(first | second), seen, len(pairs)


@pytest.mark.parametrize("most", [None, 40])
def test_driver_against_a_loop(spark, most):
    df = doubled(Tables(spark, "/root/testdata/sf0.001"))
    rows = {r["id"]: r.asDict() for r in df.collect()}
    left, remap, judged = D.dedup_companies(df, judge, FILL, most)
    want_left, want_remap, seen, pairs = loop(rows, judge, most)
    assert sorted((r.a, r.b, r.merged) for r in judged.collect()) == sorted(seen)
    assert dict(map(tuple, remap.select("loser", "survivor").collect())) == want_remap
    assert {r["id"]: tuple(r[c] for c in FILL) for r in left.collect()} == {i: tuple(r[c] for c in FILL) for i, r in want_left.items()}
    assert pairs > 40 and len(want_remap) > 10


def test_nulls_and_none(spark):
    schema = "id long, name string, website string, hq_city string, hq_state string, description_long string, created_at date, p_size int"
    left, remap, judged = D.dedup_companies(spark.createDataFrame([], schema), judge, FILL)
    assert left.collect() == remap.collect() == judged.collect() == []
    rows = [(1, None, None, None, None, None, None, 1), (2, None, "", "x", "y", "", None, 1), (3, "Acme", "not a url", "x", "Y", None, None, 1), (4, "Acme", None, "X", "y", None, None, 99)]
    _, remap, judged = D.dedup_companies(spark.createDataFrame(rows, schema), lambda a, b: False, FILL)
    assert remap.collect() == [] and [(r.a, r.b, r.merged) for r in judged.collect()] == [(3, 4, False)]


@pytest.mark.parametrize("most", [None, 60])
def test_copies_against_a_loop(spark, most):
    """Many rows of few names: a class is walked by id, and only what is left of it meets other classes."""
    names = ["Acme Labs", "acme  labs", "Acme Lab", "Acme Labs Inc", "Beta Works", "Beta Work", "Gamma"]
    rows = {i: {"id": i, "name": names[i * i % 7], "website": f"https://www.d{i}.example.com" if i % 3 else None, "hq_city": "x" if i % 2 else None, "hq_state": f"s{i % 3}", "description_long": "d" if i % 5 == 0 else None, "created_at": None if i % 11 == 0 else date(2001, 1, 1 + i % 9), "p_size": i * 7 % 50} for i in range(150)}
    df = spark.createDataFrame([tuple(r.values()) for r in rows.values()], "id long, name string, website string, hq_city string, hq_state string, description_long string, created_at date, p_size int")
    _, remap, judged = D.dedup_companies(df, judge, FILL, most)
    low = date(1, 1, 1)
    _, want, seen, pairs = loop({i: dict(r, created_at=r["created_at"] or low) for i, r in rows.items()}, judge, most)
    assert sorted((r.a, r.b, r.merged) for r in judged.collect()) == sorted(seen)
    assert dict(map(tuple, remap.select("loser", "survivor").collect())) == want and pairs > 2000


def test_first_pairs_are_the_first_of_all(spark):
    df = doubled(Tables(spark, "/root/testdata/sf0.001"))
    order = lambda p: sorted((-r.similarity, r.a, r.b) for r in p.collect())
    every = order(D.name_pairs(df))
    for most in (1, 7, 150):
        assert order(D.name_pairs(df, most))[:most] == every[:most]
    assert len(order(D.name_pairs(df, 7))) <= 14
