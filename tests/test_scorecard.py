import itertools
import random

from fathomline.operators import scorecard as R


def test_alignment_against_all_assignments():
    rng = random.Random(1)
    for _ in range(400):
        n, m = rng.randint(0, 4), rng.randint(0, 4)
        worth = [[rng.choice([0, 0, 1, 2, 3]) for _ in range(m)] for _ in range(n)]
        best = None
        for columns in itertools.permutations([*range(m), *[None] * n], n):
            pairs = [(i, j) for i, j in enumerate(columns) if j is not None and worth[i][j] > 0]
            key = (-sum(worth[i][j] for i, j in pairs), sum(dict(pairs).get(i, 0) * (m + 1) ** (n - 1 - i) for i in range(n)))
            if best is None or key < best[0]:
                best = (key, pairs)
        got = R.align(worth)
        assert sum(worth[i][j] for i, j in got) == -best[0][0] and len({i for i, _ in got}) == len({j for _, j in got}) == len(got), worth
        assert sum(dict(got).get(i, 0) * (m + 1) ** (n - 1 - i) for i in range(n)) == best[0][1], worth


def test_sets_records_and_fields(spark):
    role = "struct<company:string,role:string,start:int>"
    schema = f"case_id int, want_state string, got_state string, want_tags array<string>, got_tags array<string>, want_jobs array<{role}>, got_jobs array<{role}>"
    rows = [
        (1, "live", "live", ["A", "b "], ["a", "c"], [("Acme", "CTO", 2001), ("Acme", "CEO", 2005), ("Bo", None, None)], [("acme ", "CEO", 2005), ("Acme", "CTO", None), ("Acme", "x", 1)]),
        (2, None, "live", None, ["z", "Z"], None, [("Cy", "r", 1)]), (3, None, None, [], [], [("Dee", "r", 1)], []), (4, "x", None, ["q"], ["q"], [(" ", "r", 1)], None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in R.accuracy(df, ["state"]).collect()] == [("state", 4, 0.5)]
    assert [tuple(r)[:4] for r in R.set_scores(df, ["tags"]).collect()] == [("tags", 2, 4, 3)]
    got = {r.field: (r.hits, r.given, r.wanted) for r in R.record_scores(df, "jobs", "company", ["role", "start"]).collect()}
    assert got == {"company": (2, 4, 4), "role": (2, 4, 3), "start": (1, 3, 3)}
