"""Near copies by word-shingle similarity: SimHash links first, then an exact search for what 64 bits can't tell.

Texts of equal words are one text. The SimHash search (segment bit counts, grid, Manhattan bound, exact Hamming
distance) links texts whose fingerprints are equal or differ in ``RADIUS`` bits or fewer; each link counts only if the whole texts' shingle sets
are alike. Texts of similarity 0.8 differ in about ten bits, where no grid of 64 bits is selective, so the pairs
that are not linked by then are found by prefix filtering:

All texts put their shingles in one global order: those that a sample of the texts finds common last, the
others by hash. Texts of similarity s share more than the last s-th part of their shingles, so they share one
of the first ``n - ceil(s n) + 1``. Any order that all texts agree on is right; the sample only sets its speed.

A bucket is the texts of one such shingle. Small buckets compare all their pairs. In larger ones a text first meets
the closest of its buckets' first members (those with the fewest shingles before the shared one: a copied original, mostly). After
that most of a bucket is one component, and every text of another component meets all of the bucket's, dealt
over blocks. So no pair that could link two components is left out.
Before whole texts are read, a pair's parity sketches are compared: each shingle flips one of ``BITS`` bits, so texts differ
in at least as many shingles as their sketches in bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import simhash
from fathomline.llm.common import components, discard, settle
from fathomline.llm.simhash import SEED

WORDS = 5
SIMILARITY = 0.8
RADIUS = 3  # bits of the SimHash search
BITS = 512  # of a parity sketch
SAMPLE, SAMPLE_LEAST = 0.125, 2000  # share of the texts whose shingles are counted, and texts at least
COMMON = 3  # texts of the sample that a common shingle is in
MOST = 200_000  # common shingles that the order knows
SMALL = 8  # texts of a bucket that compares all pairs at once
BLOCK = 1024  # texts of a block of a larger bucket


def _hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's word shingles in order, A-Z lower-cased; fewer words are one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter([digest(line[i:j], SEED) for i, j in pairs], np.uint64, len(parts) - words + 1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(_hashes(text, words))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the global order of ``common`` (sorted) and its ``counts``; a near copy shares one of them."""
    n = len(hashes)
    if not n:
        return hashes
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    least = max(1, int(np.ceil(similarity * n - 1e-6)))
    return hashes[np.argsort(rank, kind="stable")][: n - least + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """Which bits an odd number of the distinct ``hashes`` flip, in signed longs."""
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _apart(x: str, y: str):
    return F.expr(" + ".join(f"bit_count({x}odd[{i}] ^ {y}odd[{i}])" for i in range(BITS // 64)))


def _close(x: str, y: str, similarity: float):
    """Columns ``odd`` and ``n`` of two sides don't rule out ``similarity``."""
    return _apart(x, y) <= (1 - similarity) / (1 + similarity) * F.expr(f"{x}n + {y}n") + 1e-6


def _shingled(words: int):
    def run(batches):
        for batch in batches:
            found = [shingles((text.as_py() or "").encode(), words) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["key"])

    return run


def _sketches(words: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            d1, d2, fps, sizes, odd, keys = [], [], [], [], [], []
            for text in batch.column(3):
                body = (text.as_py() or "").encode()
                line = b" ".join(body.lower().split())
                every = _hashes(body, words)
                hashes = np.unique(every)
                d1.append(xxhash.xxh64_intdigest(line, 1))
                d2.append(xxhash.xxh64_intdigest(line, 2))
                fps.append(simhash.majority(every))
                sizes.append(len(hashes))
                odd.append(parity(hashes))
                keys.append(prefix(hashes, common, counts, similarity))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in range(3)),
                    *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d1, d2, fps)),
                    pa.array(sizes, pa.int32()),
                    pa.array(odd, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["id", "t1", "t2", "d1", "d2", "fp", "n", "odd", "keys"],
            )

    return run


def _verify(words: int, similarity: float):
    def run(batches):
        last, sets = [None, None], [None, None]
        for batch in batches:
            keep = []
            for n in range(batch.num_rows):
                for side in (0, 1):
                    text = batch.column(2 + side)[n].as_py()
                    if text != last[side]:
                        last[side], sets[side] = text, shingles(text.encode(), words)
                first, other = sets
                both = len(np.intersect1d(first, other, assume_unique=True))
                keep.append(both >= similarity * (len(first) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are common in a sample of ``texts(id, t1, body)``, sorted, and how many of its texts have them."""
    share = min(1.0, max(SAMPLE, SAMPLE_LEAST / max(1, texts.count())))
    drawn = texts.where(F.pmod(F.xxhash64("id", "t1"), F.lit(1_000_000)) < int(1_000_000 * share)).select("body")
    found = drawn.mapInArrow(_shingled(words), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "key").limit(MOST).collect()
    keys, counts = np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _met(left: DataFrame, right: DataFrame, on: list[str], where, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``node, n, pos, root`` in different components that meet ``on`` and whose sizes, and what follows the shingle, allow ``similarity``."""
    names = ["node", "n", "pos", "root", "odd", "main"]
    x = left.select(*on, *[F.col(c).alias(f"x{c}") for c in names if c in left.columns])
    y = right.select(*on, *[F.col(c).alias(f"y{c}") for c in names if c in right.columns])
    both = 1 + F.least(F.expr("xn - xpos - 1"), F.expr("yn - ypos - 1"))
    need = (similarity * (F.col("xn") + F.col("yn")) - 1e-6) / (1 + similarity)
    met = x.join(y, on).where(F.expr("xroot <> yroot")).where(where).where(both >= need)
    if "odd" in left.columns:
        met = met.where(_close("x", "y", similarity))
    met = met.where(F.least("xn", "yn") >= similarity * F.greatest("xn", "yn") - 1e-6)
    return met.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows(node, ...)`` with the ``root`` of each node's component."""
    return rows.join(roots.select("node", F.col("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")


def _rest(shared: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs of larger buckets' texts in different components: those outside a bucket's largest component against blocks of all."""
    now = _rooted(shared.where(F.col("size") > SMALL).select("key", "node", "n", "pos"), roots)
    parts = now.groupBy("key", "root").agg(F.count("*").alias("c"))
    split = parts.groupBy("key").agg(F.sum("c").alias("m"), F.max_by("root", "c").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    dealt = now.join(split.select("key", "m", "main"), "key").join(texts.select("node", "odd"), "node")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    outside = dealt.where("root <> main").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    return _met(outside, dealt, ["key", "block"], F.expr("yroot = ymain or xnode < ynode"), similarity)


class _Search:
    """The search over one table: ``sketches`` of its rows, its distinct ``texts`` as nodes, and the components' ``roots``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, radius: int):
        self.words, self.similarity = words, similarity
        body = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(F.col(id_col).alias("id"), *_digests(body), body.alias("body"))
        kind = self.rows.schema["id"].dataType.simpleString()
        schema = f"id {kind}, t1 long, t2 long, d1 long, d2 long, fp long, n int, odd array<long>, keys array<long>"
        sketches = settle(self.rows.mapInArrow(_sketches(words, similarity, *_common(self.rows, words)), schema), "sketches")
        low = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "t1", "t2")).alias("low")
        texts = sketches.groupBy("d1", "d2").agg(low, *[F.any_value(c).alias(c) for c in ("fp", "n", "odd", "keys")])
        self.texts = settle(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
        self.sketches = settle(sketches.select("id", "t1", "t2", "d1", "d2"), "rows")
        discard(sketches)
        self.repeats = not self.sketches.groupBy("id", "t1", "t2").count().where("count > 1").isEmpty()
        self.roots = self._roots(radius)

    def _roots(self, radius: int) -> DataFrame:
        proposed = self._by_fingerprint(radius)
        edges = self._linked(proposed)
        roots = components(edges)
        entries = _rooted(self.texts.select("node", "n", "keys"), roots).select("node", "n", "root", F.posexplode("keys").alias("pos", "key"))
        sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        shared = settle(entries.join(sizes, "key"), "shared")
        few, many = shared.where(F.col("size") <= SMALL), shared.where(F.col("size") > SMALL)
        first = F.min(F.struct((F.col("pos") / F.col("n")).alias("before"), "node", "n", "pos", "root")).alias("first")
        fewest = many.groupBy("key").agg(first).select("key", "first.node", "first.n", "first.pos", "first.root")
        small = _met(few, few, ["key"], F.expr("xnode < ynode"), self.similarity)
        large = _met(many, fewest, ["key"], F.expr("xnode <> ynode"), self.similarity)
        met = settle(self._near(small).select("a", "b").unionByName(self._closest(large)).distinct(), "pairs")
        more = self._linked(met)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = components(edges)
        rest = settle(_rest(shared, self.texts, roots, self.similarity).join(met, ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            more = self._linked(rest)
            if not more.isEmpty():
                roots = components(edges.unionByName(more))
        for done in (shared, met, rest):
            discard(done)
        return roots

    def _by_fingerprint(self, radius: int) -> DataFrame:
        """Pairs of texts that SimHash links: those of one fingerprint, and one of each of two linked fingerprints."""
        points = settle(self.texts.groupBy("fp").agg(F.min("node").alias("low")), "points")
        same = self.texts.select("node", "fp").join(points, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
        near = simhash.links(points.select("fp"), radius).toDF("fa", "fb")
        near = near.join(points.toDF("fa", "a"), "fa").join(points.toDF("fb", "b"), "fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return settle(self._near(same.unionByName(near).distinct()).select("a", "b"), "pairs")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose parity sketches allow the similarity, with the bits ``apart``."""
        sketch = self.texts.select("node", "n", "odd")
        for side in "ab":
            pairs = pairs.join(sketch.toDF(side, f"{side}n", f"{side}odd"), side)
        return pairs.where(_close("a", "b", self.similarity)).select("a", "b", _apart("a", "b").alias("apart"))

    def _closest(self, pairs: DataFrame) -> DataFrame:
        """For each text the nearest of its ``pairs`` by parity sketch."""
        near = self._near(pairs)
        both = near.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "apart")
        return both.groupBy("node").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose whole texts are alike."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = wanted.join(self.texts.select("node", "low"), "node").select("node", F.col("low.id").alias("own"), "low.t1", "low.t2")
        rows = self.rows.dropDuplicates(["id", "t1", "t2"]) if self.repeats else self.rows
        bodies = rows.join(wanted, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("own"))).select("node", "body")
        bodies = settle(bodies, "bodies")
        full = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        out = settle(full.mapInArrow(_verify(self.words, self.similarity), "a long, b long"), "links")
        discard(bodies)
        return out

    def lows(self) -> DataFrame:
        """``(root, low)``: each component's first row."""
        return _rooted(self.texts.select("node", "low"), self.roots).groupBy("root").agg(F.min("low").alias("low"))


def _digests(body) -> list:
    return [F.xxhash64(F.lit(seed), body).alias(name) for seed, name in ((1, "t1"), (2, "t2"))]


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``id_col`` and ``component_id``: the smallest id linked to it by texts of ``similarity`` or more.

    Similarity is that of the sets of ``words``-word shingles. Null texts are empty, and texts of no word are
    equal to each other; a null id is linked like any other and names a component only if it has no other;
    rows that repeat, or repeat an id with another text, come out once each, by their own text; very long
    texts are compared whole; an empty table gives an empty result; other columns are not looked at.
    """
    found = _Search(docs, id_col, text_col, words, similarity, radius)
    named = _rooted(found.texts.select("node", "d1", "d2"), found.roots).join(found.lows(), "root").select("d1", "d2", F.col("low.id").alias("component_id"))
    return found.sketches.select("id", "d1", "d2").join(named, ["d1", "d2"]).select(F.col("id").alias(id_col), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """One whole row of each group of near copies: that of the smallest id (null ids last), then text digest.

    Groups and edge cases are those of ``near_copies``; of rows equal in id and text any one stays. All columns are kept.
    """
    found = _Search(docs, id_col, text_col, words, similarity, radius)
    low = found.lows().select(F.col("low.id").alias("own"), "low.t1", "low.t2")
    digests = _digests(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), *digests)
    kept = rows.join(low, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("own")))
    if found.repeats:
        kept = kept.dropDuplicates(["id", "t1", "t2"])
    return kept.select("row.*")
