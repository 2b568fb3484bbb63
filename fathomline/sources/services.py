"""Calls to outside services from tasks: checked answers, one retry, and a breaker.

``call`` takes a row and returns a record. A record that isn't of the fields asked for is asked for once more. ``RateLimited`` opens a
task's breaker: its further rows are skipped unseen, so that a later run may take them. Nothing a service does fails the job;
``answered`` and ``refused`` part what came back.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.operators.corroborate import best_corroboration
from fathomline.sources.landing import kept


HELD = 100  # rows of a batch that a task holds as records


class RateLimited(RuntimeError):
    """The service wants no further calls."""


#: Checks of a field's value by its type's name.
VALID = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "bigint": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "int": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "double": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def problem(record, fields: dict[str, str], required: set[str], allowed: dict[str, set]) -> str | None:
    """What is wrong with a record, or None."""
    if not isinstance(record, dict):
        return "no record"
    for name, kind in fields.items():
        value = record.get(name)
        if value is None:
            if name in required:
                return f"{name} is absent"
        elif not VALID[kind](value):
            return f"{name} is no {kind}"
        elif name in allowed and value not in allowed[name]:
            return f"{name} is none of the allowed values"
    return None


def ask(rows: DataFrame, call: Callable[[dict], dict], answer: str, keep: list[str], required: tuple[str, ...] = (), allowed: dict[str, set] | None = None) -> DataFrame:
    """``keep``, the fields of ``answer`` (a schema), ``outcome`` and ``detail`` of each row.

    Outcomes: ``ok``; ``invalid`` (twice of another shape); ``error`` (the call failed); ``rate_limited`` (this call opened the breaker);
    ``skipped`` (the breaker was open). Fields are null but for ``ok``. Write the result down before using it twice, as each use calls again.
    """
    asked = StructType.fromDDL(answer)
    fields = {f.name: f.dataType.simpleString() for f in asked.fields}
    known = {"required": set(required), "allowed": allowed or {}}
    unknown = set(fields.values()) - VALID.keys()
    if unknown:
        raise ValueError(f"answers of {', '.join(sorted(unknown))} can't be checked")

    def one(row: dict) -> tuple[dict, str, str | None]:
        wrong = None
        for _ in range(2):
            try:
                record = call(row)
            except RateLimited:
                return {}, "rate_limited", None
            except Exception as failed:
                return {}, "error", type(failed).__name__
            wrong = problem(record, fields, known["required"], known["allowed"])
            if wrong is None:
                return record, "ok", None
        return {}, "invalid", wrong

    def run(batches):
        broken = False
        for batch in batches:
            answers = []
            for row in (r for n in range(0, batch.num_rows, HELD) for r in batch.slice(n, HELD).to_pylist()):
                record, outcome, detail = ({}, "skipped", None) if broken else one(row)
                broken |= outcome == "rate_limited"
                answers.append([*(record.get(f) for f in fields), outcome, detail])
            columns = list(zip(*answers)) if answers else [[] for _ in range(len(fields) + 2)]
            kinds = [*(ARROW[k] for k in fields.values()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*keep, *fields, "outcome", "detail"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, {answer}, outcome string, detail string")


ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def answered(found: DataFrame) -> DataFrame:
    return found.where("outcome = 'ok'").drop("outcome", "detail")


def refused(found: DataFrame, keep: list[str]) -> DataFrame:
    """The rows that a later run must ask again, with the reason."""
    return found.where("outcome <> 'ok'").select(*keep, "outcome", "detail")


VERDICT = "is_subject boolean, confidence string, other_entity string"
CONFIDENCES = {"high", "medium", "low"}


def strong() -> Column:
    """The cheap check alone speaks for the company: a mention that isn't part of a longer name, and a word of its description."""
    return ~F.col("suspect") & (F.col("proper") - F.col("extended") >= 1) & (F.col("overlap") >= 1)


def guard(articles: DataFrame, call: Callable[[dict], dict], key: list[str], distrust: bool = False) -> DataFrame:
    """``key``, ``attach``, ``reason`` and ``other_entity``: whether an article belongs to its company.

    ``articles`` has ``key``, ``name``, ``description``, ``text`` and ``context``. A company without a description takes the article; so
    does one for which ``strong`` speaks, unless ``distrust``. Others are asked of the service: a match that isn't of low confidence attaches, a
    mismatch doesn't, and neither do articles that it failed on or that its breaker left out, which may be asked again.
    """
    profiled = F.coalesce(F.trim("description"), F.lit("")) != ""
    given = articles.select(*key, "name", "description", "text", "context")
    bare = given.where(~profiled).select(*key, F.lit(True).alias("attach"), F.lit("no-profile").alias("reason"), F.lit(None).cast("string").alias("other_entity"))
    # written down: whoever is sure and whoever is asked are told apart by one reading of the texts
    seen = kept(best_corroboration(given.where(profiled), key, context="context").select(*key, (strong() & F.lit(not distrust)).alias("strong")), "seen")
    sure = seen.where("strong").select(*key, F.lit(True).alias("attach"), F.lit("strong-corroboration").alias("reason"), F.lit(None).cast("string").alias("other_entity"))
    doubtful = given.where(profiled).join(seen.where("not strong").select(*key), key, "left_semi")
    told = ask(doubtful, call, VERDICT, key, ("is_subject", "confidence"), {"confidence": CONFIDENCES})
    match = (F.col("outcome") == "ok") & F.col("is_subject") & (F.col("confidence") != "low")
    reason = F.when(match, F.concat(F.lit("match-"), "confidence")).when(F.col("outcome") == "ok", "mismatch").when(F.col("outcome") == "skipped", "circuit-open").when(F.col("outcome") == "rate_limited", "rate-limited").otherwise("error")
    asked = told.select(*key, F.coalesce(match, F.lit(False)).alias("attach"), reason.alias("reason"), F.when(~match, F.col("other_entity")).alias("other_entity"))
    return bare.unionByName(sure).unionByName(asked)
