import __spark_entry__ as entry
from fathomline.operators import rounds
from fathomline.sources.tables import Tables


def test_rounds_of_every_company(spark, sf_dir):
    t, queries = Tables(spark, sf_dir), entry.queries()
    got = {r.id for r in queries["M5_reconciled"](spark, sf_dir).collect()}
    assert got == {r.id for r in t.rounds.select("id").collect()}
    want = {tuple(r) for r in rounds.collapse_near_amounts(t.rounds, t.links).collect()}
    assert {tuple(r) for r in queries["M18_near_amounts"](spark, sf_dir).collect()} == want
