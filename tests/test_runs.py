import pytest
from pyspark.sql import functions as F

from fathomline.operators.health import health
from fathomline.sources import services as S
from fathomline.sources.ledger import LedgeredTable


def rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_a_run_that_dies_between_the_phases_counts_once(spark, tmp_path, monkeypatch):
    table = LedgeredTable(spark, f"file://{tmp_path}/t")
    ids = lambda: sorted(r.id for r in table.read("id long").collect())
    assert ids() == [] and table.ledger().collect() == []
    assert table.write(rows(spark, [1, 2]), "a", "load", "2024-01-01", inputs_seen=3)
    with monkeypatch.context() as m:  # killed after its rows are written
        m.setattr(LedgeredTable, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.write(rows(spark, [3, 4]), "b", "load", "2024-01-02")
    assert ids() == [1, 2] and not table.committed("b")
    assert table.write(rows(spark, [3, 4]), "b", "load", "2024-01-02") and ids() == [1, 2, 3, 4]
    assert not table.write(rows(spark, [3, 4]), "b", "load", "2024-01-03") and ids() == [1, 2, 3, 4]
    late = table.stage(rows(spark, [9]))  # another attempt of the same run, slower
    assert not table.commit("b", {"stage": "load", "folder": late}) and ids() == [1, 2, 3, 4]
    with pytest.raises(Exception, match="broken"):
        table.write(rows(spark, [5]).select(F.raise_error(F.lit("broken")).alias("id")), "c", "load", "2024-01-04")
    assert table.write(rows(spark, []), "d", "load", "2024-01-05")
    got = sorted((r.run.split(".")[0], r.status, r.rows_written, r.inputs_seen) for r in table.ledger().collect())
    assert got == [("a", "success", 2, 3), ("b", "success", 2, None), ("c", "error", 0, None), ("d", "empty", 0, None)]
    assert table.vacuum() == 3 and ids() == [1, 2, 3, 4] and table.vacuum() == 0


def test_service_outcomes(spark):
    def call(row, asked={}):  # noqa: B006 — counts calls within a task
        n = row["id"]
        asked[n] = asked.get(n, 0) + 1
        if n == 1:
            raise ValueError
        if n == 6:
            raise S.RateLimited
        return {2: None, 3: {"x": "1"}, 4: {"x": None} if asked[n] == 1 else {"x": 4, "y": "b"}, 5: {"x": 5, "y": "c"}}.get(n, {"x": n, "y": None})

    got = S.ask(rows(spark, range(9)).coalesce(1).sortWithinPartitions("id"), call, "x bigint, y string", ["id"], ("x",), {"y": {"b"}})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (0, 0, None, "ok", None), (1, None, None, "error", "ValueError"), (2, None, None, "invalid", "no record"), (3, None, None, "invalid", "x is no bigint"), (4, 4, "b", "ok", None),
        (5, None, None, "invalid", "y is none of the allowed values"), (6, None, None, "rate_limited", None), (7, None, None, "skipped", None), (8, None, None, "skipped", None),
    ]
    assert S.ask(rows(spark, []), call, "x bigint", ["id"]).collect() == []


def test_entity_guard_ladder(spark):
    cases = [  # description, text, attach, reason, other
        (None, "anything", True, "no-profile", None), ("  ", None, True, "no-profile", None),
        ("mobile money transfers across Senegal", "Wave moves mobile money in Senegal", True, "strong-corroboration", None),
        ("mobile money transfers across Senegal", "hair wave tips: ask-high", True, "match-high", None), ("mobile money transfers across Senegal", "wave ask-low", False, "mismatch", "Other"),
        ("mobile money transfers across Senegal", "Primary Wave sang. Primary Wave. ask-no", False, "mismatch", "Other"), ("mobile money transfers across Senegal", None, False, "error", None),
        ("mobile money transfers across Senegal", "wave ask-limit", False, "rate-limited", None), ("mobile money transfers across Senegal", "wave ask-high", False, "circuit-open", None),
    ]

    def call(row):
        text = row["text"] or ""
        if "ask-limit" in text:
            raise S.RateLimited
        word = text.rsplit("ask-", 1)[1] if "ask-" in text else None
        return word and {"is_subject": word != "no", "confidence": "high" if word == "no" else word, "other_entity": "Other"}

    df = spark.createDataFrame([(n, "Wave", d, t, "") for n, (d, t, *_) in enumerate(cases)], "id long, name string, description string, text string, context string")
    calm = {r.id: tuple(r)[1:] for r in S.guard(df.where("id <> 7"), call, ["id"]).collect()}
    assert calm == {n: c[2:] for n, c in enumerate(cases) if n < 7} | {8: (True, "match-high", None)}
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # the breaker is a task's
    try:
        got = {r.id: r.reason for r in S.guard(df, call, ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[7] == "rate-limited" and set(got.values()) >= {"no-profile", "strong-corroboration"}
    assert {r.reason for r in S.guard(df.where("id = 2"), lambda row: {"is_subject": False, "confidence": "high"}, ["id"], distrust=True).collect()} == {"mismatch"}


def test_health_labels(spark):
    runs = [("fine", 1, "error", 1), ("fine", 2, "success", 9), ("fails", 1, "success", 1), ("fails", 2, "error", 0), ("fails", 3, "error", 0), ("fails", 4, "error", 0), ("once", 3, "success", 1), ("once", 4, "error", 0), ("quiet", 1, "success", 5), ("hollow", 4, "empty", 0), ("short", 4, "success", 2), ("unplanned", 4, "success", 1)]
    df = spark.createDataFrame([(i, s, f"2024-01-0{d}", st, n) for i, (s, d, st, n) in enumerate(runs)], "id long, stage string, started_at string, status string, rows_written long").withColumn("started_at", F.col("started_at").cast("timestamp"))
    plan = spark.createDataFrame([(s, 3, 3) for s in ("fine", "fails", "once", "quiet", "short", "absent")], "stage string, quiet_days int, floor long")
    got = {r.stage: (r.label, r.in_a_row, r.detail) for r in health(df, plan, "2024-01-05").collect()}
    assert got == {
        "fine": ("ok", 1, None), "fails": ("failing", 3, "3 errors in a row"), "once": ("error", 1, None), "quiet": ("silent", 1, "4 days without a run"), "hollow": ("empty", 1, None),
        "short": ("low", 1, "2 rows under 3"), "unplanned": ("ok", 1, None), "absent": ("missing", None, None),
    }
