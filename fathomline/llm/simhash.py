"""SimHash near-duplicates, found by a grid range-join over per-segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of its segments
(0, 1 or 2) are a point in 32 dimensions. The Manhattan distance of two points never
exceeds the Hamming distance of their fingerprints, so it is a lower bound. Counts are kept
in unary (00, 01, 11), which makes the Manhattan distance one XOR and one bit count.

The grid: the 32 dimensions form ``radius + 3`` groups, and a cell is the exact value of
three of those groups. Points within Manhattan distance ``radius`` differ in ``radius``
groups at most, so they share a cell at least: no link can be lost. Within a cell the
Manhattan bound drops most pairs and the exact Hamming distance decides the rest.

Equal fingerprints are one point, so exact copies cost nothing. A cell yields a spanning
forest, not its pairs. Cells above ``CROWD`` points are dealt again over finer groups of the
dimensions; cells crowded even so go by groups of the bits themselves, of which all but
``radius`` agree. What is left open there is few bits, so a cell's distinct points are bounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import components, settle

SEED = 42
BLOCK = 1 << 18  # shingles hashed at a time
CROWD = 4096  # points of a cell compared directly at the first level
FLUSH = 1 << 19  # rows compared at a time
LOW = 0x5555555555555555


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of ``text``: A-Z lower-cased, ``words``-word shingles with repeats, XXH64 seed 42.

    A bit is set if it is set in more than half of the hashes. Fewer words than ``words`` are
    one shingle; no word gives 0.
    """
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    if n < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = n - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        to = min(total, at + BLOCK)
        pairs = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())
        hashes = np.fromiter([digest(line[i:j], SEED) for i, j in pairs], np.uint64, to - at)
        ones += _bit_counts(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle ``hashes``: the bits set in more than half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += _bit_counts(hashes[at : at + BLOCK])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 128 * 128
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return count


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` of each row; ``fp`` holds the 64 bits as a signed long. Null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.fromiter(
                (fingerprint(x.as_py().encode(), words) if x.is_valid else 0 for x in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def bit_counts(fps: np.ndarray) -> np.ndarray:
    """Per-segment bit counts in unary: low bit of a segment = any bit set, high bit = both set."""
    low = np.uint64(LOW)
    one = np.uint64(1)
    a, b = fps & low, (fps >> one) & low
    return (a | b) | ((a & b) << one)


def _group_masks(dims: list[int], parts: int) -> list[int]:
    return [sum(3 << (2 * d) for d in part) for part in np.array_split(np.array(dims, dtype=object), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell (rows sorted by cell) within ``radius`` bits."""
    marks = bit_counts(fps)
    left, right = [], []
    idx = np.arange(len(cell))
    step = 1
    while True:
        idx = idx[idx + step < len(cell)]
        idx = idx[cell[idx] == cell[idx + step]]
        if not len(idx):
            break
        near = idx[np.bitwise_count(marks[idx] ^ marks[idx + step]) <= radius]  # Manhattan, a lower bound
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]  # exact
        left.append(fps[near])
        right.append(fps[near + step])
        step += 1
        if sum(map(len, left)) > 4 * FLUSH:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links ``a[i]-b[i]``: as many rows as points at most."""
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _matcher(radius: int, crowd: int | None):
    """Batches of ``(cell, fp)`` sorted by cell to links ``(a, b, cell)``; crowded cells' points come back with ``b`` null."""

    def out(a, b, cell):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b, cell], ["a", "b", "cell"])

    def flush(cell, fps):
        if crowd is not None:
            _, first, count = np.unique(cell, return_index=True, return_counts=True)
            big = np.repeat(count > crowd, count)
            if big.any():
                yield out(fps[big], pa.nulls(int(big.sum()), pa.int64()), pa.array(cell[big]))
                cell, fps = cell[~big], fps[~big]
        a, b = _forest(*_link(cell, fps, radius))
        if len(a):
            yield out(a, pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= FLUSH:
                cell, fps = map(np.concatenate, zip(*held))
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if cut:
                    yield from flush(cell[:cut], fps[:cut])
                held, rows = [(cell[cut:], fps[cut:])], len(cell) - cut
        if rows:
            yield from flush(*map(np.concatenate, zip(*held)))

    return run


def _deal(points: DataFrame, masks: list[int], take: int, extra: list[str], bits: bool = False) -> DataFrame:
    """``(cell, fp)``: each point in the cell of every choice of ``take`` groups of dimensions, or of bits."""
    low = F.lit(LOW)
    a = F.col("fp").bitwiseAND(low)
    b = F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    unary = a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    choices = [sum(c) for c in combinations(masks, take)]
    points = points.withColumn("u", F.col("fp") if bits else unary)
    cells = F.array(*[F.xxhash64(F.lit(n), F.col("u").bitwiseAND(F.lit(_signed(m))), *extra) for n, m in enumerate(choices)])
    return points.select(F.explode(cells).alias("cell"), "fp")


def _bit_masks(parts: int) -> list[int]:
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(64), parts)]


def links(points: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs ``points(fp)`` whose transitive closure is that of all pairs within ``radius`` bits."""
    dims = list(range(32))
    # groups, how many of them a cell fixes, and whether they are of bits; the last leaves 64 * radius / (radius + 13) bits open
    levels = [(_group_masks(dims, radius + 3), 3, False), (_group_masks(dims, radius + 6), 6, False), (_bit_masks(radius + 13), 13, True)]
    found, now, extra = None, points, []
    for n, (masks, take, bits) in enumerate(levels):
        final = n == len(levels) - 1
        dealt = _deal(now, masks, take, extra, bits).repartition("cell").sortWithinPartitions("cell")
        met = settle(dealt.mapInArrow(_matcher(radius, None if final else crowd), "a long, b long, cell long"), "grid")
        some = met.where("b is not null").select("a", "b")
        found = some if found is None else found.unionByName(some)
        now, extra = met.where("b is null").select(F.col("a").alias("fp"), F.col("cell").alias("old")).distinct(), ["old"]
        if final or now.isEmpty():
            return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, crowd: int = CROWD
) -> DataFrame:
    """Each row's fingerprint and near-duplicate component.

    Returns ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``: the
    smallest id that links of ``radius`` bits or fewer reach, itself included. Null text is
    empty; texts without a word have fingerprint zero and link like any other; a repeated row
    comes out as often as it comes in; a null id never names a component unless it is alone
    in it (then ``component_id`` is null); other columns are not looked at; an empty table
    gives an empty result.
    """
    marked = settle(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = marked.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(points.select("fp"), radius, crowd))
    known = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = settle(known, "points")
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
