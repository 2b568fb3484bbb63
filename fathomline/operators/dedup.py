"""The whole de-duplication of companies: one domain is one company, then alike names that a judge confirms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.urls import canonical_domain
from fathomline.operators.components import components
from fathomline.operators.grouped import scan
from fathomline.operators.resolve import merge_entities, resolve_remap
from fathomline.operators.similarity import alike_classes, fuzzy_pairs
from fathomline.sources.landing import kept

NAME_LIKENESS, NEIGHBOUR_LIKENESS = 0.45, 0.30  # fixed values: of names anywhere, and of names in one city
MOST_JUDGED = 200  # pairs that a run may have judged
JUDGED = "a long, b long, similarity double, merged boolean, loser long, survivor long"
BLANK = ""

#: A judge says whether two companies' rows are surely one company.
Judge = Callable[[dict, dict], bool]


def preference() -> Column:
    """The smallest is the row that survives: described at length, with a site, older, of the smaller id."""
    absent = lambda c: F.coalesce(F.col(c), F.lit(BLANK)) == BLANK
    return F.struct(absent("description_long").alias("undescribed"), absent("website").alias("homeless"), "created_at", "id")


def domain_remap(companies: DataFrame) -> DataFrame:
    """``(loser, survivor)`` of companies whose sites have one canonical domain."""
    rows = companies.select("id", "description_long", "website", "created_at", canonical_domain(F.col("website")).alias("domain")).where("domain is not null")
    best = Window.partitionBy("domain")
    named = rows.withColumn("survivor", F.min(preference()).over(best)["id"])
    return named.where("id <> survivor").select(F.col("id").alias("loser"), "survivor")


def name_pairs(companies: DataFrame, most: int | None = None) -> DataFrame:
    """``(a, b, similarity)``, a < b: names alike anywhere, or less alike in one city.

    With ``most`` at least the first so many of them, the most alike first, then the smaller ids; not all pairs are made then.
    """
    names = companies.select("id", "name")
    place = F.lower(F.concat_ws("|", "hq_city", "hq_state"))
    settled = companies.where("hq_city is not null and hq_state is not null").select("id", "name", place.alias("place"))
    if most is None:
        alike = fuzzy_pairs(names, names, NAME_LIKENESS, distinct_order=True)
        near = fuzzy_pairs(settled, settled, NEIGHBOUR_LIKENESS, distinct_order=True, block="place")
    else:
        alike = _first_pairs(alike_classes(names, names, NAME_LIKENESS), most)
        near = _first_pairs(alike_classes(settled, settled, NEIGHBOUR_LIKENESS, block="place"), most)
    both = alike.unionByName(near).groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))
    return both.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "similarity")


def _first_pairs(classes: tuple[DataFrame, DataFrame, DataFrame], most: int) -> DataFrame:
    """The ``most`` first pairs of rows, the most alike first, then the smaller ids.

    Two classes, named by their smallest ids, have that pair of ids as their first one; where ``most`` pairs of classes begin earlier, all
    their pairs of rows come later. Of two classes the pair of their r-th and s-th row has r * s - 1 pairs before it, within one class r * (s - r) - 1.
    """
    pairs, rows, _ = classes
    placed = rows.select("id", "class").withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("n") <= most + 1)
    second = placed.where("n = 2").select(F.col("class").alias("x"), F.col("id").alias("second"))
    begun = pairs.where("x <= y").join(second, "x", "left").withColumn("next", F.when(F.expr("x < y"), F.col("y")).otherwise(F.col("second"))).where("next is not null")
    chosen = begun.orderBy(F.desc("similarity"), "x", "next").limit(most).select("x", "y", "similarity")
    met = chosen.join(placed.toDF("i", "x", "r"), "x").join(placed.toDF("j", "y", "s"), "y").where(f"(x < y and r * s <= {most}) or (x = y and r < s and r * (s - r) <= {most})")
    return met.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"), "similarity").orderBy(F.desc("similarity"), "left_id", "right_id").limit(most)


def judged_remap(companies: DataFrame, pairs: DataFrame, judge: Judge, most: int | None = MOST_JUDGED) -> DataFrame:
    """``(a, b, similarity, merged, loser, survivor)`` of the pairs that ``judge`` saw, the most alike first.

    A pair with a company that an earlier pair merged away isn't judged. Whether one is depends on pairs of its connected
    component only, so components are walked apart, each in order; only the ids merged away are held. Of more than
    ``most`` pairs the most alike are taken; the others wait for the next run.
    """
    order = [F.desc("similarity"), F.asc("a"), F.asc("b")]
    chosen = kept(pairs.orderBy(*order).limit(most) if most is not None else pairs, "judged")
    rows = companies.withColumn("rank", preference())
    facts = rows.select("id", F.struct(*rows.columns).alias("facts"))
    both = chosen.join(facts.select(F.col("id").alias("a"), F.col("facts").alias("first")), "a").join(facts.select(F.col("id").alias("b"), F.col("facts").alias("second")), "b")
    both = both.join(components(chosen).withColumnRenamed("node", "a"), "a").withColumn("a_stays", F.col("first.rank") < F.col("second.rank"))

    def begin():
        gone = set()

        def step(row: dict) -> list[tuple]:
            a, b = row["a"], row["b"]
            if a in gone or b in gone:
                return []
            if not judge(row["first"], row["second"]):
                return [(a, b, row["similarity"], False, None, None)]
            survivor, loser = (a, b) if row["a_stays"] else (b, a)
            gone.add(loser)
            return [(a, b, row["similarity"], True, loser, survivor)]

        return step

    return scan(both, "root", order, begin, JUDGED)


def judged_whole(companies: DataFrame, judge: Judge) -> DataFrame:
    """``judged_remap`` of all ``name_pairs``, of which those of equal names are never made.

    Pairs of similarity 1 come first, and lie within the classes of one set of trigrams. A class is walked by id, each row before those
    that are left of the smaller ones: pairs that share a row keep their order, so the verdicts are the same. What is left of all
    classes meets as pairs.
    """
    names = companies.select("id", "name")
    _, rows, _ = alike_classes(names, names, 1.0)
    ranked = companies.withColumn("rank", preference())
    namesakes = rows.select("id", "class").join(ranked.select("id", F.struct(*ranked.columns).alias("facts")), "id")

    def place(facts: dict) -> tuple:
        r = facts["rank"]
        return (r["undescribed"], r["homeless"], r["created_at"] is not None, r["created_at"], r["id"])  # as Spark sorts: nulls first

    def begin():
        left: list[dict] = []

        def step(row: dict) -> list[tuple]:
            mine, b, out = row["facts"], row["id"], []
            for held in list(left):
                a = held["id"]
                if not judge(held, mine):
                    out.append((a, b, 1.0, False, None, None))
                elif place(held) < place(mine):
                    return out + [(a, b, 1.0, True, b, a)]
                else:
                    out.append((a, b, 1.0, True, a, b))
                    left.remove(held)
            left.append(mine)
            return out

        return step

    first = kept(scan(namesakes, "class", [F.asc("id")], begin, JUDGED), "namesakes")
    alive = kept(companies.join(first.where("merged").select(F.col("loser").alias("id")), "id", "left_anti"), "alive")
    return first.unionByName(judged_remap(alive, name_pairs(alive).where("similarity < 1"), judge, None))


def dedup_companies(companies: DataFrame, judge: Judge, fill: list[str], most: int | None = MOST_JUDGED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies without duplicates, ``(loser, survivor)`` for whatever refers to them, and what was judged.

    ``companies`` has ``id, name, website, hq_city, hq_state, description_long, created_at`` and the columns of ``fill``, which
    survivors take from their losers where they have none. Domains merge first; the survivors' names meet then.
    """
    first = kept(domain_remap(companies), "domains")
    merged = kept(merge_entities(companies, first, fill), "merged")
    verdicts = judged_whole(merged, judge) if most is None else judged_remap(merged, name_pairs(merged, most), judge, most)
    judged = kept(verdicts, "verdicts")
    second = judged.where("merged").select("loser", "survivor")
    second = resolve_remap(second)
    remap = resolve_remap(first.unionByName(second))
    return merge_entities(merged, second, fill), remap, judged
