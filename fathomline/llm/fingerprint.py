"""Canonical exact fingerprints, in DataFrame functions only.

Canonical form: compatibility normalisation (NFKC), full case folding, NFKC again, and runs of
white space folded to one space, none at the ends. The fingerprint is two differently seeded
64-bit xxHashes of it. Equal fingerprints make a bucket; inside a bucket the canonical
bytes are compared, so that a collision can't join different texts.

Spark has no normalisation function of its own; ``reflect`` calls the one of the ICU library
that Spark brings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import settle

ICU = "com.ibm.icu."
RANGE_BYTES = 32 << 20  # of text in a range
MOST_RANGES = 1 << 14  # bounds that the driver holds; beyond, ranges grow
TEXT, GUEST, RIDER = 0, 1, 2  # order of rows within a range


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit(ICU + "text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.reflect(F.lit(ICU + "lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits in 32 hex digits."""
    parts = [F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*parts))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=wide_hash) -> DataFrame:
    """``(id, fingerprint, class_id)``: the smallest id among the rows of the same canonical bytes.

    Rows alone in their bucket are left out: they are their own class. A null text is empty; a null id
    names a class only if no other id does.
    Texts of crowded buckets are compared with one reference text each, in an equi-join that
    adaptive execution may split; they are never gathered.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    marked = settle(rows.select("id", hasher(canonical(F.col("body"))).alias("fingerprint")), "fingerprints")
    shared = _shared(marked).withColumnRenamed("id", "own")
    members = rows.join(shared, F.col("id").eqNullSafe(F.col("own"))).select("id", "fingerprint", "head", canonical(F.col("body")).alias("canon"))
    members = settle(members.where(hasher(F.col("canon")) == F.col("fingerprint")), "members")
    return _classes(members)


def _shared(marked: DataFrame) -> DataFrame:
    """``(id, fingerprint, head)`` of the rows that share their bucket; ``head`` is the bucket's smallest id."""
    buckets = marked.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1").drop("n")
    return marked.join(buckets, "fingerprint").select("id", "fingerprint", "head").distinct()


def _classes(members: DataFrame) -> DataFrame:
    """``(id, fingerprint, class_id)`` by comparing each of ``members(id, fingerprint, head, canon)`` with its head's bytes."""
    heads = members.where(F.col("id").eqNullSafe(F.col("head"))).groupBy("fingerprint").agg(F.min("canon").alias("reference"))
    judged = members.join(heads, "fingerprint").withColumn("same", F.col("canon") == F.col("reference"))
    equal = judged.where("same").select("id", "fingerprint", F.col("head").alias("class_id"))
    other = judged.where("not same")  # collisions only
    named = other.groupBy("fingerprint", "canon").agg(F.min("id").alias("class_id"))
    rest = other.join(named, ["fingerprint", "canon"]).select("id", "fingerprint", "class_id")
    return equal.unionByName(rest).groupBy("id", "fingerprint").agg(F.min("class_id").alias("class_id"))


def _bucket(bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``id``; 0 for null. Two levels, so wide arrays aren't gone through for each row."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[a : a + step] for a in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)

    def under(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.coalesce(F.col("id"), F.lit(-(1 << 63)))))

    coarse = under(F.array(*[F.lit(g[0]) for g in groups]))
    fine = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + under(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def with_next(rows: DataFrame, columns: list[str], parts: int, riders: DataFrame) -> DataFrame:
    """``rows(id, body, ...)`` with ``next_<c>`` for each of ``columns``: the value in the next row by id, the first row's after the last.

    Also ``head``: that of ``riders(id, fingerprint, head)`` of the same id and fingerprint. These small rows go through the
    same exchange, so that texts are not dealt once more to meet them. Ids are dealt to ``parts`` ranges; each range also gets the first row of the range after it, so no
    task sees more than its range. The driver holds a few numbers for each range.
    """
    spread = [n / parts for n in range(1, parts)]
    found = rows.select(F.percentile_approx("id", F.array(*[F.lit(x) for x in spread]), 20 * parts)).first()[0] if spread else None
    bounds = sorted(set(found or []))
    ranged = rows.withColumn("range", _bucket(bounds))
    firsts = ranged.groupBy("range").agg(F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    firsts = sorted((r.range, None if r.nulls else r.low) for r in firsts)
    if not firsts:
        return ranged.select(*rows.columns, *[F.col(c).alias(f"next_{c}") for c in columns], F.col("id").alias("head"), F.lit(False).alias("grouped"))
    before = {r: firsts[n - 1][0] for n, (r, _) in enumerate(firsts)}
    low = dict(firsts)
    span = range(len(bounds) + 1)
    kind = rows.schema["id"].dataType
    lows = F.array(*[F.lit(low.get(r)).cast(kind) for r in span])
    previous = F.array(*[F.lit(before.get(r, -1)) for r in span])
    at = F.col("range") + 1
    is_first = F.element_at(lows, at).eqNullSafe(F.col("id"))
    own = F.struct(F.col("range").alias("part"), F.lit(TEXT).alias("kind"))
    guest = F.struct(F.element_at(previous, at).alias("part"), F.lit(GUEST).alias("kind"))
    dealt = ranged.withColumn("place", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "place.part", "place.kind")
    dealt = dealt.unionByName(riders.withColumn("part", _bucket(bounds)).withColumn("kind", F.lit(RIDER)), allowMissingColumns=True)
    dealt = dealt.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    order = Window.partitionBy("part").orderBy("kind", "id", "body")
    mine = Window.partitionBy("part", "id", "fingerprint")
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return dealt.withColumn("head", F.max("head").over(mine)).withColumn("grouped", F.max(F.col("kind") == RIDER).over(mine)).where(F.col("kind") == TEXT).drop("part", "kind")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=wide_hash) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how they compare.

    The edited text has the last quarter of its code points (rounded down) replaced by as many of
    the next document's first ones, or all it has; next is by ascending id, after the last the first.
    Returns ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` (1 if the canonical bytes are equal, else 0) and ``class_id`` (smallest id
    of equal canonical text). A null text is empty; null ids come first in the order; equal ids follow
    by text; a repeated row repeats; a lone row is its own next; an empty table gives an empty
    result; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    printed = rows.withColumn("fingerprint", hasher(canonical(F.col("body"))))
    shared = settle(_shared(settle(printed.select("id", "fingerprint"), "prints")), "shared")
    paired = with_next(printed, ["body", "fingerprint"], parts, shared)
    n = F.length("body")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("body", F.lit(1), n - quarter), F.substr("next_body", F.lit(1), quarter))
    paired = paired.select("id", "body", "fingerprint", "head", "grouped", "next_body", "next_fingerprint", edited.alias("edited"))
    paired = paired.withColumn("edited_canon", canonical(F.col("edited")))
    paired = paired.withColumn("edited_fingerprint", hasher(F.col("edited_canon")))

    def same(bucket: Column, other: Column) -> Column:  # bytes are compared inside equal buckets only
        return F.when(F.col("fingerprint") == bucket, (canonical(F.col("body")) == other).cast("double")).otherwise(F.lit(0.0))

    marked = settle(
        paired.select(
            "id",
            F.length("body").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            same(F.col("edited_fingerprint"), F.col("edited_canon")).alias("near_edited"),
            same(F.col("next_fingerprint"), canonical(F.col("next_body"))).alias("near_next"),
            "head",
            F.when(F.col("grouped"), canonical(F.col("body"))).alias("canon"),
        ),
        "fingerprints",
    )
    classes = _classes(marked.where("canon is not null").select("id", "fingerprint", "head", "canon"))
    classes = classes.select(F.col("id").alias("own"), F.col("fingerprint").alias("bucket"), "class_id")
    out = marked.join(classes, F.col("id").eqNullSafe(F.col("own")) & (F.col("fingerprint") == F.col("bucket")), "left")
    return out.select(
        F.col("id").alias(id_col), *[c for c in marked.columns if c not in ("id", "head", "canon")], F.coalesce("class_id", "id").alias("class_id")
    )
