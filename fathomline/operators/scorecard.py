"""Scores of recorded answers against expected ones."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """What an evaluation looks at: the slots of its cases, and the floors of its scores."""

    name: str
    slots: tuple[str, ...]
    floors: dict[str, float] = field(default_factory=dict)


def gate(cases: DataFrame, spec: Spec) -> DataFrame:
    """``(spec, metric, value, floor, ok)`` for each floor of ``spec``."""
    scores = slot_scores(cases, list(spec.slots))
    rows = [F.struct(F.lit(spec.name).alias("spec"), F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).alias("floor"), (F.col(m) >= f).alias("ok")) for m, f in spec.floors.items()]
    return scores.select(F.inline(F.array(*rows)))


def _ratio(a: Column, b: Column) -> Column:
    """``a`` of ``b``; 1 of nothing."""
    return F.when(b == 0, 1.0).otherwise(a / F.nullif(b, F.lit(0)))


def slot_scores(cases: DataFrame, slots: list[str], by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 over nullable slots; ``cases`` has ``want_<slot>`` and ``got_<slot>``.

    A slot is a hit if both are equal and not null; a wrong value is a false find and a miss.
    """
    pairs = [(F.col(f"want_{s}"), F.col(f"got_{s}")) for s in slots]
    count = lambda tests: sum((F.sum(F.coalesce(t, F.lit(False)).cast("long")) for t in tests), F.lit(0))
    hits = count([w == g for w, g in pairs])
    tally = cases.groupBy(*(by or [])).agg(hits.alias("hits"), count([g.isNotNull() for _, g in pairs]).alias("given"), count([w.isNotNull() for w, _ in pairs]).alias("wanted"))
    precision, recall = _ratio(F.col("hits"), F.col("given")), _ratio(F.col("hits"), F.col("wanted"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return tally.select(*(by or []), "hits", "given", "wanted", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def structure_ok(text: Column, least: int, most: int) -> Column:
    """One line of ``least`` to ``most`` characters that ends a sentence or a number."""
    return F.coalesce(F.length(text).between(least, most) & ~text.contains("\n") & text.rlike(r"[.!?\d]$"), F.lit(False))


def load_cases(landed: DataFrame, expected: str, text: str = "value") -> DataFrame:
    """``case_id``, ``provenance``, ``parsed`` and the fields of ``recorded`` (null if the record doesn't fit ``expected``) of landed JSON cases."""
    schema = f"case_id long, provenance string, recorded struct<{expected}>"
    df = landed.select(F.from_json(text, schema).alias("c")).select("c.*").where("case_id is not null")
    return df.select("case_id", "provenance", F.col("recorded").isNotNull().alias("parsed"), "recorded.*")


def accuracy(cases: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, cases, value)``: the share of cases in which ``want_<field>`` and ``got_<field>`` are equal; null equals null only."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"want_{f}").eqNullSafe(F.col(f"got_{f}")).alias("same")) for f in fields])
    told = cases.select(F.inline(rows)).groupBy("field").agg(F.count("*").alias("cases"), F.avg(F.col("same").cast("double")).alias("value"))
    return told


def _names(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array()), lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def set_scores(cases: DataFrame, sets: list[str]) -> DataFrame:
    """``(field, hits, given, wanted, precision, recall, f1)`` over all cases of the sets ``want_<set>`` and ``got_<set>``, letter case and blanks apart."""
    sides = {s: (_names(F.col(f"want_{s}")), _names(F.col(f"got_{s}"))) for s in sets}
    rows = F.array(*[F.struct(F.lit(s).alias("field"), F.size(F.array_intersect(w, g)).alias("hits"), F.size(g).alias("given"), F.size(w).alias("wanted")) for s, (w, g) in sides.items()])
    tally = cases.select(F.inline(rows)).groupBy("field").agg(*[F.sum(c).alias(c) for c in ("hits", "given", "wanted")])
    return _with_ratios(tally)


def _with_ratios(tally: DataFrame) -> DataFrame:
    precision, recall = _ratio(F.col("hits"), F.col("given")), _ratio(F.col("hits"), F.col("wanted"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return tally.withColumns({"precision": precision, "recall": recall, "f1": f1})


def align(worth: list[list[int]]) -> list[tuple[int, int]]:
    """The one-to-one pairs of rows and columns of the greatest total worth; pairs worth nothing are left out.

    Of equally good totals the one that gives the first row its earliest column wins, then the second row, and so on. Shortest augmenting
    paths, so cubic in the records of one case.
    """
    n, m = len(worth), max(map(len, worth), default=0)
    if not n or not m:
        return []
    size = max(n, m)
    # ties: what a pair is worth is scaled so that all ties together weigh less than one unit
    cost = [[0] * size for _ in range(size)]
    for i in range(n):
        for j in range(m):
            if worth[i][j] > 0:
                cost[i][j] = -(worth[i][j] * (m + 1) ** n - j * (m + 1) ** (n - 1 - i))
    u, v, owner = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        owner[0], at = i, 0
        least, back, done = [None] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while owner[at]:
            done[at], row, step, to = True, owner[at], None, 0
            for j in range(1, size + 1):
                if not done[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if least[j] is None or reduced < least[j]:
                        least[j], back[j] = reduced, at
                    if step is None or least[j] < step:
                        step, to = least[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = sorted((owner[j] - 1, j - 1) for j in range(1, size + 1))
    return [(i, j) for i, j in pairs if i < n and j < m and worth[i][j] > 0]


def record_scores(cases: DataFrame, records: str, key: str, fields: list[str]) -> DataFrame:
    """``(field, hits, given, wanted, precision, recall, f1)`` of lists of records ``want_<records>`` and ``got_<records>``.

    A case's records are aligned one to one before they count: only records of equal ``key`` (a text, letter case and blanks apart) may meet, and the
    alignment with most equal ``fields`` in all is taken. The row of ``key`` counts aligned records, the others their equal values that aren't null;
    a record without a partner counts as given or wanted alone.
    """
    weight = len(fields) + 1

    def tally(batches):
        import pandas as pd

        for pdf in batches:
            totals = {f: [0, 0, 0] for f in (key, *fields)}
            for want, got in zip(pdf["want"], pdf["got"]):
                want, got = ([dict(r) for r in (side if side is not None else []) if r is not None and (r[key] or "").strip()] for side in (want, got))
                text = lambda x: x.strip().lower() if isinstance(x, str) else x
                same = lambda a, b, f: a[f] is not None and a[f] == a[f] and text(a[f]) == text(b[f])
                pairs = align([[weight + sum(same(a, b, f) for f in fields) if text(a[key]) == text(b[key]) else 0 for b in got] for a in want])
                for f, t in totals.items():
                    t[0] += sum(same(want[i], got[j], f) for i, j in pairs)
                    t[1] += sum(r[f] is not None and r[f] == r[f] for r in got)
                    t[2] += sum(r[f] is not None and r[f] == r[f] for r in want)
            yield pd.DataFrame([(f, *t) for f, t in totals.items()], columns=["field", "hits", "given", "wanted"])

    rows = cases.select(F.col(f"want_{records}").alias("want"), F.col(f"got_{records}").alias("got"))
    parts = rows.mapInPandas(tally, "field string, hits long, given long, wanted long")
    return _with_ratios(parts.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("hits", "given", "wanted")]))
