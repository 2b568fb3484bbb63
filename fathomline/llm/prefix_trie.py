"""Prefix tries of conversations: mergeable tables of nodes, and sums over subtrees.

A node is a distinct sequence of first turns, known by its depth and two hashes: polynomials modulo 2^61 - 1 over the
turns' SHA-256 digests, at two points drawn for each run. Prefix sums give the hashes of all prefixes, so a very
long conversation may lie in many tasks; only the sums of conversations that cross tasks travel through the driver.

Each partition's turns are combined into a table of its nodes; tables are merged by node, first within ``BRANCHES``
branches, then over all, so no task meets a common node more often than there are partial tables of its branch.
Every merge also keeps the least and greatest digest of a node's last turn and of its parent: these are equal
for all members, or two sequences share a hash and the run fails instead of giving a wrong result.

Sums over subtrees climb by doubling: in a round of step s each node adds its sum to its ancestor s levels up. A
node finds it as the place at that depth of its own smallest member, so no common ancestor is a join's hot key.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import discard, look_up, settle

P61 = (1 << 61) - 1
BRANCHES = 64
CHUNK = 4096  # ids of a chunk of an end list
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "h1", "h2"]


def _runs(first: np.ndarray, begin: bool) -> np.ndarray:
    """Of sorted keys: where each row's run begins; the first row's at 0 or, if it goes on from before, at -1."""
    fresh = np.empty(len(first), bool)
    fresh[0] = begin
    fresh[1:] = first[1:] != first[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(first)), -1))


def _number(batches):
    """Sorted (conv_id, digest, words) with the task and each row's place in its conversation's run there."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        begin = _runs(conv, conv[0] != last)
        place = np.arange(len(conv)) - begin
        place[begin < 0] += count - 1
        last, count = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), *batch.columns[1:]], ["conv_id", "part", "place", "digest", "words"])


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, part, pos, digest, words)``: each turn's position in its conversation, its digest and its words, written to the shared folder.

    Turns go by ``turn``, nulls first, and equal ones by their digests; null roles and texts are empty; rows without a
    conversation are left out; repeated rows are turns of their own. A conversation may lie in several parts.
    """
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_col, text_col))
    sized = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(turns[conv_col].isNotNull()).select(
        turns[conv_col].cast("long").alias("conv_id"),
        turns[turn_col].alias("turn"),
        F.unhex(F.substring(F.sha2(sized, 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")
    numbered = settle(rows.mapInArrow(_number, "conv_id long, part int, place long, digest binary, words long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    later = runs.where(F.col("before").isNotNull()).select("conv_id", "part", "before")  # fewer rows than there are parts
    rows = numbered.join(F.broadcast(later), ["conv_id", "part"], "left")
    return rows.select("conv_id", "part", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def share_beginnings(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt upon the first turns of their family's head, from what ``ordered`` gives.

    Conversation c takes the first h turns of c - c % ``family`` (all if fewer, none if absent), then its own turns after
    its first h; h is crc32 of its decimal id modulo ``most``. Remainders have the sign of the id.
    Returns ``(conv_id, pos, digest, words)`` and ``(conv_id, length)``, the latter with conversations left without turns.
    """
    runs = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    head = F.col("conv_id") - F.col("conv_id") % family
    plan = sizes.select("conv_id", "n", head.alias("head"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("skip"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("offered"))
    plan = plan.join(heads, "head", "left").withColumn("taken", F.least("skip", F.coalesce("offered", F.lit(0))))
    plan = settle(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))), "families")
    # a part's rows of one conversation meet one row, however long the conversation is
    parted = runs.select("conv_id", "part").join(plan.select("conv_id", "skip", "taken"), "conv_id")
    own = turns.join(parted, ["conv_id", "part"]).where(F.col("pos") >= F.col("skip"))
    own = own.select("conv_id", (F.col("pos") - F.col("skip") + F.col("taken")).alias("pos"), "digest", "words")
    first = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("head"), "pos", "digest", "words")
    lent = plan.where("taken > 0").select("conv_id", "head", "taken").join(first, "head").where(F.col("pos") < F.col("taken"))
    return own.unionByName(lent.select("conv_id", "pos", "digest", "words")), plan.select("conv_id", "length")


def _hashes(points: tuple[int, int]):
    """Sorted (conv_id, pos, digest, words) with the sums of this task's run of the conversation, before and with each turn."""

    def run(batches):
        part, last, sums = TaskContext.get().partitionId(), None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, pos = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            halves = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").reshape(-1, 2)
            out = np.empty((4, len(conv)), np.int64)
            power, at = [0, 0], -2
            for n, (c, p, digest) in enumerate(zip(conv, pos, halves.tolist())):
                fresh = c != last
                for i in (0, 1):
                    power[i] = power[i] * points[i] % P61 if p == at + 1 and not fresh else pow(points[i], p + 1, P61)
                    out[i, n] = 0 if fresh else sums[i]
                    sums[i] = out[2 + i, n] = (int(out[i, n]) + (digest[i] % (P61 - 1) + 1) * power[i]) % P61
                last, at = c, p
            marks = halves.astype(np.uint64).view(np.int64)
            arrays = [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(np.array(pos) + 1), *map(pa.array, out), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in (0, 1)), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "depth", "p1", "p2", "h1", "h2", "d1", "d2", "words"])

    return run


def _places(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``(conv_id, depth, h1, h2, p1, p2, d1, d2, words, length)``: a row for each prefix of each conversation, the root's too."""
    points = (secrets.randbelow(P61 - 2) + 2, secrets.randbelow(P61 - 2) + 2)
    rows = rows.select("conv_id", "pos", "digest", "words").repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    kinds = "conv_id long, part int, depth long, p1 long, p2 long, h1 long, h2 long, d1 long, d2 long, words long"
    summed = settle(rows.mapInArrow(_hashes(points), kinds), "prefixes")
    runs = summed.groupBy("conv_id", "part").agg(F.max(F.struct("depth", "h1", "h2")).alias("end"))
    split = runs.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    carried, sums = [], (None, 0, 0)
    for r in split.select("conv_id", "part", "end.h1", "end.h2").orderBy("conv_id", "part").collect():  # two a part at most
        before = sums if sums[0] == r["conv_id"] else (r["conv_id"], 0, 0)
        carried.append((r["conv_id"], r["part"], before[1], before[2]))
        sums = (r["conv_id"], (before[1] + r["h1"]) % P61, (before[2] + r["h2"]) % P61)
    carry = rows.sparkSession.createDataFrame(carried, "conv_id long, part int, c1 long, c2 long")
    summed = summed.join(F.broadcast(carry), ["conv_id", "part"], "left")
    add = lambda i: [F.pmod(F.col(f"{x}{i}") + F.coalesce(f"c{i}", F.lit(0)), F.lit(P61)).alias(f"{x}{i}") for x in "hp"]
    turns = summed.select("conv_id", "depth", *add(1), *add(2), "d1", "d2", "words")
    zero = F.lit(0).cast("long")
    roots = members.select("conv_id", *[zero.alias(c) for c in ("depth", "h1", "h2", "p1", "p2", "d1", "d2", "words")])
    return turns.unionByName(roots)


def merged(places: DataFrame) -> DataFrame:
    """Node tables of all partitions, merged by node within branches and then over them."""
    tables = places.select(
        *NODE, F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("first"), "words", *[F.col(c).alias(f"{end}_{c}") for c in ("p1", "p2", "d1", "d2") for end in ("low", "high")]
    ).withColumn("branch", F.spark_partition_id())
    for branches in (BRANCHES, 1):
        tables = tables.groupBy(*NODE, (F.col("branch") % branches).alias("branch")).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("words").alias("words"),
            *[f(f"{end}_{c}").alias(f"{end}_{c}") for c in ("p1", "p2", "d1", "d2") for end, f in (("low", F.min), ("high", F.max))],
        )
    same = F.lit(True)
    for c in ("p1", "p2", "d1", "d2"):
        same &= F.col(f"low_{c}") == F.col(f"high_{c}")
    return tables.select(*NODE, F.col("low_p1").alias("p1"), F.col("low_p2").alias("p2"), F.col("first").alias("conv_id"), F.col("n").alias("n_convs"), "words", same.alias("same"))


def _chunks(batches):
    """Sorted (node, conv_id) to (node, first id, decimal ids of a run joined by commas); a run has ``CHUNK`` ids at most."""
    key, ids = None, []
    rows: list[tuple] = []
    names = [*NODE, "first", "ids"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def close():
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key or len(ids) == CHUNK:
                close()
                key, ids = node, []
            ids.append(conv)
        if rows:
            yield batch_of(rows)
            rows.clear()
    close()
    if rows:
        yield batch_of(rows)


def _digest_ends(batches):
    """Chunks sorted by node and first id to each node's digest, a chunk in memory at a time."""
    key, state = None, None
    for batch in batches:
        rows = []
        for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*NODE, "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*NODE, "ends"])


def _ends(places: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, ends)``: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas."""
    last = places.join(members.select(F.col("conv_id"), F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi")
    by = [*NODE, "conv_id"]
    chunks = last.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "depth long, h1 long, h2 long, first long, ids string")
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return chunks.mapInArrow(_digest_ends, "depth long, h1 long, h2 long, ends string")


def _climb(nodes: DataFrame, places: DataFrame, values: list[str], top: int) -> DataFrame:
    """``nodes`` (node, conv_id, values) of depth 1 and more with each value summed over the node's subtree."""
    state, step = nodes, 1
    while step < top:
        below = state.where(F.col("depth") > step).select("conv_id", (F.col("depth") - step).alias("depth"), *values)
        given = below.join(places.where(F.col("depth") > 0).select("conv_id", *NODE), ["conv_id", "depth"])
        given = given.select(*NODE, F.lit(None).cast("long").alias("conv_id"), *values)
        both = state.unionByName(given).groupBy(*NODE).agg(F.max("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values])
        new = settle(both, "subtrees")
        if step > 1:
            discard(state)
        state, step = new, step * 2
    return state


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows(conv_id, pos, digest, words)``, positions from 0 without gaps, and ``members(conv_id, length)``.

    Returns per node, the root included: ``conv_id`` (smallest member; with ``depth`` it names the node's turns), ``depth``,
    ``parent_conv_id`` (the parent's ``conv_id``; null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, which includes itself), ``saved_tokens`` (over its subtree: members but one, times the
    words of a node's last turn) and ``ends_sha256`` (ids of members that end here). Members without turns are the
    root's. No members: no nodes.
    """
    places = settle(_places(rows, members), "places")
    nodes = settle(merged(places), "nodes")
    top, same = nodes.agg(F.max("depth"), F.min("same")).first()
    if same is False:
        raise ArithmeticError("two sequences of turns share a hash; run again")
    parents = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    nodes = nodes.join(parents.agg(F.count("*").alias("n_children")), NODE, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = settle(nodes, "nodes")
    values = ["n_leaves", "saved_tokens"]
    leaves, saved = nodes.agg(*[F.sum(v) for v in values]).first()  # the root's
    sums = _climb(nodes.where("depth > 0").select(*NODE, "conv_id", *values), places, values, top or 0).select(*NODE, *values)
    above = nodes.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    found = nodes.drop(*values).withColumns({"up_depth": F.col("depth") - 1, "up_h1": F.col("p1"), "up_h2": F.col("p2")})
    found = look_up(found, above, ["up_depth", "up_h1", "up_h2"], NODE)
    found = found.join(sums, NODE, "left").join(_ends(places, members), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(leaves)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(saved)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are; see ``ordered`` for nulls, ties and repeated rows, ``trie`` for the result."""
    rows = ordered(turns, **columns)
    members = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.sum("n").alias("length"))
    return trie(rows.drop("part"), members)


def rebuilt_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations rebuilt by ``share_beginnings``."""
    return trie(*share_beginnings(ordered(turns, **columns)))
