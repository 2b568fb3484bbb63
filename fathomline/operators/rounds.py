"""Duplicate funding rounds: clusters, greedy merges and reconciliation.

Near amounts meet in a band join, and the greedy merge runs in each connected component of what met, so a company may have any number
of rounds. Reconciliation passes a company's arrivals in order and finds the round to merge to by keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.names import normalized_round_type
from fathomline.functions.urls import AGGREGATORS, hostname, on_host
from fathomline.operators.components import components
from fathomline.operators.grouped import per_key, scan
from fathomline.sources.landing import kept

# fixed values: what counts as one event
NEAR_AMOUNT, WIDE_AMOUNT, WIDE_SHARED = 0.15, 0.25, 2
NEAR_DAYS, RECONCILE_DAYS = 14, 60
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def confidence_rank(c: str = "confidence") -> Column:
    return F.when(F.col(c) == "high", 2).when(F.col(c) == "medium", 1).when(F.col(c) == "low", 0)


def good_source(url: str = "news_url") -> Column:
    """A url of a publisher, not of an aggregator or of a directory."""
    host = hostname(F.col(url))
    return F.coalesce(host.isNotNull() & ~on_host(host, AGGREGATORS), F.lit(False))


def amount_clusters(rounds: DataFrame) -> DataFrame:
    """``cluster`` of each round with an amount: per company and amount, one a type.

    Untyped rounds join the type if there is exactly one, else they are a cluster of their own.
    """
    r = rounds.where("amount_raised is not null").withColumn("kind", normalized_round_type(F.col("round_type")))
    group = Window.partitionBy("company_id", "amount_raised")
    low, high = F.min("kind").over(group), F.max("kind").over(group)
    return r.withColumn("cluster", F.coalesce("kind", F.when(low == high, low), F.lit(""))).drop("kind")


def collapse_amounts(rounds: DataFrame) -> DataFrame:
    """``(loser, survivor)`` within amount clusters: typed (a placeholder is no type), dated, sure, sourced and early rounds survive."""
    order = Window.partitionBy("company_id", "amount_raised", "cluster").orderBy(
        F.desc(normalized_round_type(F.col("round_type")).isNotNull()), F.desc(F.col("announced_date").isNotNull()), F.desc_nulls_last(confidence_rank()), F.desc(good_source()), F.asc("id"))
    named = amount_clusters(rounds).withColumn("survivor", F.first("id").over(order)).where("id <> survivor")
    return named.select(F.col("id").alias("loser"), "survivor")


def near(a: float, b: float, low: float, high: float) -> bool:
    top = max(a, b)
    return a != b and top > 0 and low < (top - min(a, b)) / top <= high


def near_candidates(rounds: DataFrame) -> DataFrame:
    """``(a, b)``: rounds of a company of unequal amounts within the wide band, compatible types and dates, not both undated.

    Amounts meet on buckets as wide as the band, in logarithms, and their neighbours; dates likewise; an undated round meets the dated ones of
    its amounts' buckets.
    """
    width = -math.log(1 - WIDE_AMOUNT) * (1 + 1e-9)
    rows = rounds.where("amount > 0").select("company_id", "id", "amount", "kind", "announced_date", F.floor(F.log("amount") / width).alias("size"), F.floor(F.datediff("announced_date", F.lit("1970-01-01").cast("date")) / (NEAR_DAYS + 1)).alias("period"))
    left, right = (rows.select("company_id", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "amount", "kind", "announced_date")], "size", "period") for side in "xy")
    around = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])).alias(c)
    dated = left.where("period is not null").select(*[c for c in left.columns if c != "size"], around("size"))
    both = dated.select(*[c for c in dated.columns if c != "period"], around("period")).join(right, ["company_id", "size", "period"]).where("x_id < y_id")
    undated = dated.join(right.where("period is null").drop("period"), ["company_id", "size"])
    met = both.select(*[c for c in both.columns if c[1] == "_"]).unionByName(undated.select(*[c for c in undated.columns if c[1] == "_"]))
    top = F.greatest("x_amount", "y_amount")
    fits = (F.col("x_amount") != F.col("y_amount")) & ((top - F.least("x_amount", "y_amount")) / top <= WIDE_AMOUNT)
    fits = fits & (F.col("x_kind").isNull() | F.col("y_kind").isNull() | (F.col("x_kind") == F.col("y_kind")))
    days = F.abs(F.datediff("x_announced_date", "y_announced_date"))
    return met.where(fits & (days.isNull() | (days <= NEAR_DAYS))).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def _absorb(found: list[dict]) -> list[tuple]:
    """The greedy merge of a component's rounds, each with the ``others`` it may meet."""
    rows = {r["id"]: r | {"backers": set(r["backers"] or [])} for r in found}
    place = {i: n for n, i in enumerate(sorted(rows, key=lambda i: (rows[i]["kind"] is None, rows[i]["announced_date"] is None, 1 if rows[i]["sure"] is None else -rows[i]["sure"], i)))}
    gone, out = set(), []
    for anchor in place:
        if anchor in gone:
            continue
        a = rows[anchor]
        after = sorted((i for i in a["others"] if place[i] > place[anchor]), key=place.__getitem__)
        more = True
        while more:
            more = False
            for i in after:
                b = rows[i]
                if i not in gone and (near(a["amount"], b["amount"], 0.0, NEAR_AMOUNT) or len(a["backers"] & b["backers"]) >= WIDE_SHARED):
                    gone.add(i)
                    a["backers"] |= b["backers"]
                    out.append((i, anchor))
                    more = True
    return out


def collapse_near_amounts(rounds: DataFrame, investors: DataFrame) -> DataFrame:
    """``(loser, survivor)`` of near amounts, compatible types and dates; a wider band if investors are shared.

    Anchors go best first; each takes what matches it until nothing more does, as absorbed rounds bring
    their investors. Two undated rounds never merge. A task holds one connected component of rounds that may match at a time.
    """
    r = rounds.where("amount_raised is not null")
    r = r.select("company_id", "id", F.col("amount_raised").cast("double").alias("amount"), normalized_round_type(F.col("round_type")).alias("kind"), "announced_date", confidence_rank().alias("sure"))
    pairs = kept(near_candidates(r), "near")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("others"))
    roots = components(pairs).withColumnRenamed("node", "id")
    held = investors.withColumnRenamed("round_id", "id").join(roots.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("investor_id").alias("backers"))
    rows = r.drop("company_id").join(roots, "id").join(others, "id").join(held, "id", "left")
    return per_key(rows, "root", _absorb, "loser long, survivor long")


def fold_losers(rounds: DataFrame, remap: DataFrame, columns: list[str]) -> DataFrame:
    """Survivors whose null columns are filled from their losers, the surest first."""
    ranked = rounds.join(remap.select(F.col("loser").alias("id"), "survivor"), "id").withColumn("o", F.struct((-F.coalesce(confidence_rank(), F.lit(-1))).alias("s"), F.col("id").alias("i")))
    gifts = ranked.groupBy("survivor").agg(*[F.expr(f"min_by({c}, o) filter (where {c} is not null)").alias(f"_{c}") for c in columns])
    kept = rounds.join(remap.select(F.col("loser").alias("id")), "id", "left_anti").join(gifts.withColumnRenamed("survivor", "id"), "id", "left")
    return kept.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def reconcile(arrivals: DataFrame) -> DataFrame:
    """``(id, round_id, created)``: the round that each arriving extraction is merged to or makes.

    Arrivals of a company go by id. A type and a date that match within ``RECONCILE_DAYS`` (null matches null only)
    merge; without either only an equal amount and a compatible type do; else a round is made. A merge fills nulls of the round.
    """
    r = arrivals.select("company_id", "id", F.col("amount_raised").cast("double").alias("amount"), F.lower(F.trim(F.when(normalized_round_type(F.col("round_type")).isNotNull(), F.col("round_type")))).alias("kind"), "announced_date")

    return scan(r, "company_id", [F.col("id")], _Made, "id long, round_id long, created boolean")


class _Made:
    """The rounds made so far for one company, found by type and period and by amount."""

    def __init__(self):
        self.rounds: list[dict] = []
        self.by_event: dict[tuple, list[int]] = {}
        self.by_amount: dict[float, list[int]] = {}

    @staticmethod
    def _period(day):
        return None if day is None else day.toordinal() // (RECONCILE_DAYS + 1)

    def _enter(self, n: int) -> None:
        m = self.rounds[n]
        for table, key in ((self.by_event, (m["kind"], self._period(m["day"]))), (self.by_amount, m["amount"])):
            if n not in table.setdefault(key, []):
                table[key].append(n)

    def _find(self, kind, day, amount):
        hits = []
        if kind is not None or day is not None:
            period = self._period(day)
            for p in [None] if period is None else [period - 1, period, period + 1]:
                for n in self.by_event.get((kind, p), ()):
                    m = self.rounds[n]
                    if m["kind"] == kind and (m["day"] is None) == (day is None) and (day is None or abs((m["day"] - day).days) <= RECONCILE_DAYS):
                        hits.append(n)
        if not hits and amount is not None:
            for n in self.by_amount.get(amount, ()):
                m = self.rounds[n]
                if m["amount"] == amount and (m["kind"] is None or kind is None or m["kind"] == kind):
                    hits.append(n)
        return min(hits, default=None)

    def __call__(self, x: dict) -> list[tuple]:
        kind, day, amount = x["kind"], x["announced_date"], x["amount"]
        n = self._find(kind, day, amount)
        made = n is None
        if made:
            n = len(self.rounds)
            self.rounds.append({"id": x["id"], "kind": kind, "day": day, "amount": amount})
        else:
            m = self.rounds[n]
            m["kind"], m["day"] = m["kind"] or kind, m["day"] or day
            m["amount"] = m["amount"] if m["amount"] is not None else amount
        self._enter(n)
        return [(x["id"], self.rounds[n]["id"], made)]
