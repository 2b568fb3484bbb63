"""Vector and trigram similarity, with joins that never compare all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTORS = 4096  # vectors of a block, about
STRIP = 32  # asked vectors that meet a block at a time
PIECE, PIECES = 64, 64  # ids of a class in a piece, and pieces in a list, about


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def unit(a) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0))))


def nearest(df: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to the one-row ``query(vector)`` by exact scan; one scored pass and a bounded top-k."""
    one = query.select(F.col(vector).alias("_query")).limit(1)
    scored = df.crossJoin(F.broadcast(one)).select(id_col, cosine(F.col(vector), F.col("_query")).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def _parts(vectors: pa.Array, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at the places ``at``, of ``width`` components each, a row a component; and which of them have no null."""
    flat = vectors.take(pa.array(at)).flatten()
    whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), width).any(axis=1)
    return np.ascontiguousarray(flat.cast("double").to_numpy(zero_copy_only=False).reshape(len(at), width).T), whole


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all columns of ``a`` and ``b``, summed in the order of the components, as ``dot`` sums them."""
    out = np.zeros((a.shape[1], b.shape[1]))
    step = np.empty_like(out)
    for x, y in zip(a, b):
        np.add(out, np.multiply.outer(x, y, out=step), out=out)
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(a.shape[1])
    for x in a:
        out += x * x
    return np.sqrt(out)


def _best(asked: pa.Table, rows: pa.Table, k: int, others: bool) -> pa.Table:
    """The ``k`` best of ``rows`` for each of ``asked``, scored as ``cosine`` does but null where it isn't defined."""
    out = []
    of, ids = asked.column("query_id").to_numpy(), rows.column("id").to_numpy()
    x, y = asked.column("embedding").combine_chunks(), rows.column("embedding").combine_chunks()
    xn, yn = (pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False) for v in (x, y))
    most = min(k + others, len(ids))
    with np.errstate(all="ignore"):
        for width in np.unique(xn) if most else ():
            mine, theirs = np.flatnonzero(xn == width), np.flatnonzero(yn == width) if width >= 0 else np.empty(0, int)
            (a, a_whole), (b, b_whole) = _parts(x, mine, max(width, 0)), _parts(y, theirs, max(width, 0))
            a_norms, b_norms = _norms(a), _norms(b)
            for n in range(0, len(mine), STRIP):
                norms = np.multiply.outer(a_norms[n : n + STRIP], b_norms)
                score, known = np.zeros((len(norms), len(ids))), np.zeros((len(norms), len(ids)), bool)
                known[:, theirs] = a_whole[n : n + STRIP, None] & b_whole & (norms != 0)
                score[:, theirs] = _dots(a[:, n : n + STRIP], b) / norms
                # as Spark sorts: what is no number first, nulls last
                key = np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)
                bound = np.partition(key, len(ids) - most, axis=1)[:, len(ids) - most]
                for i, query in enumerate(of[mine[n : n + STRIP]]):
                    at = np.flatnonzero(key[i] >= bound[i])
                    if others:
                        at = at[ids[at] != query]
                    kind = np.where(known[i, at], np.where(np.isnan(score[i, at]), 0, 1), 2)
                    at = at[np.lexsort((ids[at], -key[i, at], kind))[:k]]
                    out.append((np.full(len(at), query), ids[at], score[i, at], ~known[i, at]))
    query, found, score, null = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0), np.empty(0, bool))
    return pa.table({"query_id": pa.array(query, pa.int64()), "id": pa.array(found, pa.int64()), "similarity": pa.array(score, pa.float64(), mask=null)})


def nearest_each(asked: DataFrame, rows: DataFrame, k: int, others: bool = False) -> DataFrame:
    """``(query_id, id, similarity)``: for each vector of ``asked(query_id, embedding)`` the ``k`` nearest of ``rows(id, embedding)`` by exact cosine.

    Of equals the smaller id comes first; a cosine that isn't defined is null and comes last. With ``others`` a row isn't found for a query of its own id.
    All pairs are scored: blocks of asked vectors meet blocks of rows, and each two blocks give ``k`` rows a query. So no pair is written down, and a
    task holds two blocks, whatever the tables' sizes.
    """
    counts = rows.agg(F.greatest(F.ceil(F.count("*") / VECTORS), F.lit(1)).alias("_rows")).crossJoin(asked.agg(F.greatest(F.ceil(F.count("*") / VECTORS), F.lit(1)).alias("_asked")))

    def dealt(df, key, own, other):
        place = F.pmod(F.xxhash64(key), F.col(own)).alias(own + "_block")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other + "_block")
        mine = df.select(F.col(key).cast("long").alias(key), F.col("embedding").alias("embedding"))  # named anew, as both sides may come of one table
        return mine.crossJoin(F.broadcast(counts)).select(key, "embedding", place, every)

    on = ["_rows_block", "_asked_block"]
    met = dealt(asked, "query_id", "_asked", "_rows").groupBy(*on).cogroup(dealt(rows, "id", "_rows", "_asked").groupBy(*on))
    found = met.applyInArrow(lambda a, b: _best(a, b, k, others), "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def trigrams(text) -> Column:
    """Distinct trigrams of the words of a text: lower case, two spaces before a word and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(w):
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a, b) -> Column:
    """Shared over all distinct trigrams; 0 if there is none."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - both
    return F.when(total == 0, 0.0).otherwise(both / F.nullif(total, F.lit(0)))


def alike_classes(left: DataFrame, right: DataFrame, threshold: float, id_col: str = "id", name: str = "name", block: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of one set of trigrams are a class, and classes meet, not names: ``(pairs, left rows, right rows)``.

    ``pairs(x, y, similarity)`` are the classes at or over ``threshold``, both ways and each with itself; rows are ``(id, class, members)``.
    A class is named by its smallest id; ``members`` is how many rows of both sides it has. A pair at similarity s shares at least s of the larger set, so among the rarest
    ``n - ceil(s * n) + 1`` trigrams of each class the two have one in common (prefix filtering); only classes that meet on
    such a trigram are compared. Common trigrams are never entered. With ``block`` only names of one value of that column
    meet: their trigrams carry it, so that they are rare by block and others' never meet.

    Trigrams are made once a name, and rows learn their class by their name in a merge join, so that neither rows nor their trigrams pass the driver as a broadcast.
    """
    on = ["name", "of"] if block else ["name"]

    def named(df):
        return df.select(F.col(id_col).alias("id"), F.col(name).alias("name"), *([F.col(block).alias("of")] if block else []))

    a, b = named(left), named(right)
    seen = a.unionByName(b) if left is not right else a
    grams = F.transform(trigrams(F.col("name")), lambda g: F.concat(g, F.lit("|"), F.col("of"))) if block else trigrams(F.col("name"))
    sets = seen.dropna(subset=on).groupBy(*on).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # by the count, so that the optimiser doesn't move the filter, and with it the trigrams, to the rows
    sets = sets.withColumn("grams", F.when(F.col("n") > 0, F.array_sort(grams))).where(F.size("grams") > 0)
    classes = sets.groupBy("grams").agg(F.min("id").alias("class"), F.sum("n").alias("members"))
    told = sets.join(classes, "grams").select(*on, "class", "members")
    rows = [df.join(told.hint("merge"), on).select("id", "class", "members") for df in (a, b)]
    weights = classes.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    ranked = classes.select("class", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(weights, "gram")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("n", "gram")))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
    entries = ranked.where(F.col("place") <= keep).select("class", "size", "gram")
    near = (F.least("xs", "ys") >= F.greatest("xs", "ys") * threshold - 1e-9) & (F.col("x") < F.col("y"))
    met = entries.toDF("x", "xs", "gram").join(entries.toDF("y", "ys", "gram"), "gram").where(near).select("x", "y").distinct()
    full = met.join(classes.select(F.col("grams").alias("xg"), F.col("class").alias("x")), "x").join(classes.select(F.col("grams").alias("yg"), F.col("class").alias("y")), "y")
    both = F.size(F.array_intersect("xg", "yg"))
    scored = full.select("x", "y", (both / (F.size("xg") + F.size("yg") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    ways = F.explode(F.array(F.struct("x", "y", "similarity"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "similarity")))
    itself = classes.select(F.col("class").alias("x"), F.col("class").alias("y"), F.lit(1.0).alias("similarity")).where(F.lit(1.0) >= threshold)
    return scored.select(ways.alias("p")).select("p.*").unionByName(itself), *rows


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float, id_col: str = "id", name: str = "name", distinct_order: bool = False, block: str | None = None, digits: int | None = None) -> DataFrame:
    """``(left_id, right_id, similarity)`` of names at or over ``threshold``, without comparing all pairs.

    Classes of equal sets meet (``alike_classes``), then lists of their ids. These are spread over all tasks, and give their pairs piece by piece
    at last: no join makes pairs of rows, and a task holds those of two pieces. ``distinct_order`` keeps pairs of left_id < right_id; ``digits`` rounds.
    """
    pairs, a, b = alike_classes(left, right, threshold, id_col, name, block)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))

    def lists(rows, side, ids):
        dealt = rows.withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / PIECE)))
        pieces = dealt.groupBy(F.col("class").alias(side), "piece").agg(F.collect_list("id").alias("ids"))
        return pieces.groupBy(side, F.floor(F.col("piece") / PIECES).alias("list")).agg(F.collect_list("ids").alias(ids)).drop("list")

    def pieces_of(ids):
        # the lambda keeps this out of generated code, which gives no row before it has made all that two lists have
        return F.explode(F.filter(ids, lambda piece: F.size(piece) > 0))

    once = distinct_order and left is right
    # each two classes once; the smaller id is the left one
    met = (pairs.where("x <= y") if once else pairs).join(lists(a, "x", "lefts"), "x").join(lists(b, "y", "rights"), "y")
    spread = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = spread.withColumn("left", pieces_of("lefts")).withColumn("right", pieces_of("rights"))
    each = cut.withColumn("left_id", F.explode("left")).withColumn("right_id", F.explode("right"))
    if once:
        each = each.where("x < y or left_id < right_id")
        return each.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity")
    return each.where(F.col("left_id") < F.col("right_id") if distinct_order else F.col("left_id") != F.col("right_id")).select("left_id", "right_id", "similarity")


def closest(left: DataFrame, right: DataFrame, threshold: float, k: int, id_col: str = "id", name: str = "name", digits: int | None = None) -> DataFrame:
    """``(left_id, found)``: the ``k`` most alike of the other names, of equals the smaller id; rows without any are left out.

    ``found`` is an array of structs of ``similarity`` (rounded to ``digits``) and ``right_id``, the best first. The k + 1 best of a class serve
    each of its rows, as a row leaves out itself at most; pairs of rows are never made.
    """
    pairs, a, b = alike_classes(left, right, threshold, id_col, name)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    first = b.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("n") <= k + 1)
    order = Window.partitionBy("x").orderBy(F.desc("similarity"), "right_id")
    best = pairs.join(first.select(F.col("class").alias("y"), F.col("id").alias("right_id")), "y").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = best.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("n", "similarity", "right_id"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["right_id"] != F.col("left_id")), 1, k)
    found = F.transform(others, lambda f: F.struct(f["similarity"].alias("similarity"), f["right_id"].alias("right_id")))
    asked = a.select(F.col("id").alias("left_id"), F.col("class").alias("x"))
    return asked.join(lists.hint("merge"), "x").select("left_id", found.alias("found")).where(F.size("found") > 0)


def smallest_alike(df: DataFrame, threshold: float, gate: Column, id_col: str = "id", name: str = "name") -> DataFrame:
    """``(left_id, right_id)``: for each row the smallest id of an alike name, if smaller than its own, among rows of its value of ``gate``.

    ``gate`` is an expression of ``id``. Classes are told their minima by gate; pairs of rows are never made.
    """
    pairs, rows, _ = alike_classes(df, df, threshold, id_col, name)
    gated = rows.withColumn("gate", gate)
    least = gated.groupBy(F.col("class").alias("x"), "gate").agg(F.min("id").alias("left_id"))
    told = pairs.join(least, "x").groupBy(F.col("y").alias("class"), "gate").agg(F.min("left_id").alias("left_id"))
    return gated.join(told, ["class", "gate"]).where("left_id < id").select("left_id", F.col("id").alias("right_id"))


def best_match(pairs: DataFrame, margin: float) -> DataFrame:
    """The best right side of each left side; none if the runner-up is within ``margin``."""
    order = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    out = pairs.withColumn("next", F.lead("similarity").over(order)).withColumn("n", F.row_number().over(order)).where("n = 1")
    return out.where(F.col("next").isNull() | (F.col("similarity") - F.col("next") >= margin)).select("left_id", "right_id", "similarity")


def best_alike(left: DataFrame, right: DataFrame, threshold: float, margin: float, id_col: str = "id", name: str = "name") -> DataFrame:
    """``best_match`` of the names at or over ``threshold``, without pairs of rows."""
    two = closest(left, right, threshold, 2, id_col, name)
    clear = (F.size("found") == 1) | (F.expr("found[0].similarity - found[1].similarity") >= margin)
    return two.where(clear).select("left_id", F.expr("found[0].right_id as right_id"), F.expr("found[0].similarity as similarity"))
