"""The health of stages by their ledger: streaks, silence and floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaks(runs: DataFrame) -> DataFrame:
    """``(stage, status, began, ended, runs)``: the longest runs of one status in a row, by ``started_at`` and ``id``.

    A streak is what lies between changes of status, so a stage's runs are numbered twice: among all and among those of the status.
    """
    all_ = F.row_number().over(Window.partitionBy("stage").orderBy("started_at", "id"))
    own = F.row_number().over(Window.partitionBy("stage", "status").orderBy("started_at", "id"))
    marked = runs.withColumn("isle", all_ - own)
    return marked.groupBy("stage", "status", "isle").agg(F.min("started_at").alias("began"), F.max("started_at").alias("ended"), F.count("*").alias("runs")).drop("isle")


def health(runs: DataFrame, expected: DataFrame, as_of: str, failing: int = 2) -> DataFrame:
    """``(stage, label, status, in_a_row, last_started, detail)`` for each stage that ran or was expected.

    ``expected`` has ``stage``, ``quiet_days`` (the longest silence allowed) and ``floor`` (least rows of the last run); nulls ask for nothing. Labels, the
    gravest first: ``missing`` (never ran), ``failing`` (``failing`` errors in a row or more at the end), ``error`` (the last run), ``silent`` (no run
    for too long), ``empty`` (the last run), ``low`` (under the floor), ``ok``.
    """
    now = F.lit(as_of).cast("timestamp")
    last = runs.groupBy("stage").agg(F.max_by(F.struct("status", "started_at", "rows_written"), F.struct("started_at", "id")).alias("r")).select("stage", "r.*")
    tail = streaks(runs).groupBy("stage").agg(F.max_by("runs", F.struct("ended", "began", "runs")).alias("in_a_row"))
    rows = last.join(tail, "stage").join(expected, "stage", "full")
    days = F.datediff(now, "started_at")
    label = (
        F.when(F.col("status").isNull(), "missing").when((F.col("status") == "error") & (F.col("in_a_row") >= failing), "failing").when(F.col("status") == "error", "error")
        .when(days > F.col("quiet_days"), "silent").when(F.col("status") == "empty", "empty").when(F.col("rows_written") < F.col("floor"), "low").otherwise("ok")
    )
    rows = rows.withColumn("label", label)
    detail = (
        F.when(F.col("label") == "failing", F.concat("in_a_row", F.lit(" errors in a row"))).when(F.col("label") == "silent", F.concat(days, F.lit(" days without a run")))
        .when(F.col("label") == "low", F.concat("rows_written", F.lit(" rows under "), "floor"))
    )
    return rows.select("stage", "label", "status", "in_a_row", F.col("started_at").alias("last_started"), detail.alias("detail"))
