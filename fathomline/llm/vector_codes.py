"""Product-quantised vector codes: integer codebooks by exact k-means, screened in float32.

A vector's components become integers and are cut into ``PARTS`` consecutive parts, each with its codebook. The
nearest entry of a part is searched by one float32 matrix product for all rows and entries of a batch. Each
approximate distance has an interval that its rounding errors can't leave; entries whose interval meets the best one's
are evaluated again in int64, and ties go to the lower index. So codes are exact whatever the order of summation.

Rounds are Spark jobs over all rows: tasks send sums and counts of each entry, never vectors. The driver holds the
codebooks (entries times length for each length of vectors that occurs).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import discard, look_up, settle

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
UNIT = 2.0**-24  # float32's rounding unit
LIMB = 40  # bits of a limb of a sum on its way to the driver

Codebook = list[np.ndarray]  # by part: entries x components


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x), as int64, or as Python integers where that is too narrow for exact distances."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 1 << 40:
        return scaled.astype(np.int64)
    if not np.isfinite(scaled).all():  # doubles beyond the scale's reach
        return np.array([[int(x) * scale for x in row] for row in vectors.tolist()], object)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object)


def cuts(length: int, parts: int) -> np.ndarray:
    """Where parts begin and end; a length that is no multiple gives its first parts one component more."""
    return np.cumsum([0, *(length // parts + (i < length % parts) for i in range(parts))])


def _narrow(x: np.ndarray, entries: np.ndarray) -> bool:
    top = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    return max(1, x.shape[1]) * (2 * top) ** 2 < 1 << 59


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in Python integers."""
    out = np.empty((len(x), len(entries)), object)
    for k, entry in enumerate(entries.astype(object)):
        out[:, k] = [sum((a - b) ** 2 for a, b in zip(row, entry)) for row in x.astype(object)]
    return out


def intervals(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each |entry|^2 - 2 x.entry, which orders entries as squared distances do.

    Conversions to float32 and a product of w terms, summed in any order, err by gamma(w + 2) |x| |entry| at most.
    What is done in float64 is covered by 2^-48 of the terms' size.
    """
    w = x.shape[1]
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    squares = (entries * entries).sum(axis=1).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)[None, :] * (1 + 2.0**-40)
    gamma = (w + 2) * UNIT / (1 - (w + 2) * UNIT)
    middle = squares[None, :] - 2 * product
    reach = 2 * gamma * norms + 2.0**-48 * (squares[None, :] + 2 * norms)
    return middle - reach, middle + reach


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry, the lower index of equals, and the exact squared distance."""
    if x.dtype == object or entries.dtype == object or not _narrow(x, entries):
        exact = _exact(x, entries)
        found = np.array([min(range(len(row)), key=row.__getitem__) for row in exact], np.int64)
        return found, exact[np.arange(len(x)), found]
    low, high = intervals(x, entries)
    open_ = low <= high.min(axis=1, keepdims=True)
    found = open_.argmax(axis=1)
    rows, which = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(rows):
        again = np.full(open_.shape, np.iinfo(np.int64).max)
        again[rows, which] = (entries[which] * (entries[which] - 2 * x[rows])).sum(axis=1)
        several = np.unique(rows)
        found[several] = again[several].argmin(axis=1)
    return found, ((x - entries[found]) ** 2).sum(axis=1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of each length in a column of lists."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, flat[starts[rows][:, None] + np.arange(length)[None, :]]


def _assign(vectors: np.ndarray, book: Codebook, scale: int):
    x = integers(vectors, scale)
    at = cuts(x.shape[1], len(book))
    for part, entries in enumerate(book):
        own = x[:, at[part] : at[part + 1]]
        yield part, own, *nearest(own, entries)


def _limbs(value: int):
    """Signed limbs of an integer, lowest first; those of many integers may be summed apart."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        limb += 1


def _sums(books: dict[int, Codebook], scale: int):
    """A task's sums and counts of each entry, in limbs; place -1 is the count."""

    def run(batches):
        sums: dict[tuple[int, int], list[list]] = {}
        for batch in batches:
            for length, _, vectors in _by_length(batch.column(0)):
                for part, own, found, _ in _assign(vectors, books[length], scale):
                    held = sums.setdefault((length, part), [[0] * (own.shape[1] + 1) for _ in books[length][part]])
                    for entry in np.unique(found).tolist():
                        mine = own[found == entry]
                        total = [*map(int, mine.sum(axis=0)), len(mine)]
                        held[entry] = [a + b for a, b in zip(held[entry], total)]
        rows = [
            (length, part, entry, place if place < len(total) - 1 else -1, limb, s)
            for (length, part), entries in sums.items()
            for entry, total in enumerate(entries)
            for place, value in enumerate(total)
            for limb, s in _limbs(value)
        ]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "part", "entry", "place", "limb", "s"])

    return run


def _first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> dict[int, Codebook]:
    order = Window.partitionBy("length").orderBy(F.col("id").asc_nulls_last(), "vector")
    first = rows.withColumn("length", F.size("vector")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    books: dict[int, Codebook] = {}
    taken: dict[int, list] = {}
    for r in first.select("length", "n", "vector").orderBy("length", "n").collect():
        taken.setdefault(r["length"], []).append(r["vector"])
    for length, vectors in taken.items():
        x = integers(np.array(vectors, np.float64).reshape(len(vectors), length), scale)
        at = cuts(length, parts)
        books[length] = [x[:, at[p] : at[p + 1]] for p in range(parts)]
    return books


def _tight(rows: list[list[int]], width: int) -> np.ndarray:
    """Entries as int64 where they fit."""
    fits = all(abs(v) < 1 << 40 for r in rows for v in r)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), width)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, Codebook]:
    """Codebooks by length of vectors, from ``rows(id, vector)`` without invalid vectors; every row takes part in every round."""
    books = _first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        parted = rows.select("vector").mapInArrow(_sums(books, scale), "length long, part long, entry long, place long, limb long, s long")
        total: dict[tuple, dict[int, int]] = {}
        for r in parted.groupBy("length", "part", "entry", "place", "limb").agg(F.sum("s").alias("s")).collect():
            held = total.setdefault((r["length"], r["part"], r["entry"]), {})
            held[r["place"]] = held.get(r["place"], 0) + (r["s"] << LIMB * r["limb"])
        new = {length: [b.tolist() for b in book] for length, book in books.items()}
        for (length, part, entry), held in total.items():
            width = books[length][part].shape[1]
            new[length][part][entry] = [held.get(i, 0) // held[-1] for i in range(width)]
        books = {length: [_tight(b, books[length][p].shape[1]) for p, b in enumerate(book)] for length, book in new.items()}
    return books


def digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(str(int(v)) for entries in book for entry in entries for v in entry).encode()).hexdigest()


def _codes(books: dict[int, Codebook], scale: int):
    def run(batches):
        known = {length: digest(book) for length, book in books.items()}
        for batch in batches:
            code = np.zeros((batch.num_rows, max(map(len, books.values()), default=0)), np.int64)
            error = np.zeros(batch.num_rows, object)
            shas = np.empty(batch.num_rows, object)
            for length, rows, vectors in _by_length(batch.column(0)):
                shas[rows] = known[length]
                for part, _, found, distance in _assign(vectors, books[length], scale):
                    code[rows, part] = found
                    error[rows] += np.array(distance, object)
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            error = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text), error, pa.array(shas.tolist(), pa.string())], ["id", "label", "code", "error", "sha"])

    return run


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """``id_col``, ``code`` (two hex digits a part), ``error`` (squared distances summed over parts), ``label_error`` (error
    summed over rows of an equal label, null labels together) and ``codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components are left out. Codebooks begin with the smallest ids
    (null ids last; equal ids in the order of their vectors); with fewer rows than ``entries`` they are shorter. Vectors of
    another length have codebooks of their own; a length that is no multiple of ``parts`` gives the first parts one
    component more, and empty parts have distance 0. Repeated rows count as often as they occur. An ``error`` or
    ``label_error`` beyond a long is null; codes are exact all the same. An empty table gives an empty result.
    """
    x = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vector"), vectors[label_col].alias("label"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = settle(x.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))), "vectors")
    books = train(rows, parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = settle(
        rows.select("vector", "id", "label").mapInArrow(_codes(books, scale), f"id {kinds['id']}, label {kinds['label']}, code string, error long, sha string"), "codes"
    )
    discard(rows)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.when(F.count("*") == F.count("error"), total).alias("total"))
    out = look_up(coded, sums, ["label"], ["id"])
    return out.select(
        F.col("id").alias(id_col), "code", "error", F.expr("try_cast(total as bigint)").alias("label_error"), F.col("sha").alias("codebooks_sha256")
    )
