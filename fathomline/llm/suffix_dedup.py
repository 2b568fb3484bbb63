"""Suffix-array removal of repeated byte strings, over column-wise built document collections.

A string of ``span`` bytes is repeated if it starts at two places or more of the corpus.
Finding these by one suffix array over the corpus would tie all data together, so strings
are first dealt to independent collections by content:

* Each window of ``span`` bytes takes as anchor the leftmost smallest hash among its
  ``GRAM``-byte strings. Equal windows have equal anchors at equal places, so a repeat stays
  within one collection. Consecutive windows with one anchor form a segment.
* Anchors seen once are dropped: their windows can't be repeated. Equal segments are counted into one, whatever the
  number of copies: they are known by 128 bits of BLAKE2b under a key drawn for each run, so that no text can be
  made to meet another; the quicker polynomial hash only chooses anchors.
* A segment is a document of a ``Collection``: its symbols are its words of eight bytes, counted from the anchor. Each
  round inserts one symbol of each document into the collection's Burrows-Wheeler transform and common prefixes.
* A window of ``span`` bytes is up to seven bytes, then whole symbols, then the rest of eight bytes. Suffixes in one run of common
  prefixes long enough agree on the whole symbols; the transform's symbol before them and the one after tell the rest.
  Equal windows whose counts sum to two or more are repeated.

An anchor of more than ``CROWD`` different segments is dealt again: a segment's windows are halved by the anchor's place in them, and
each half goes by the bytes that all its windows share, which grow with each halving, at last to the whole window. So every
collection has a bounded number of documents and is built as above, whatever the data.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.collection import CHUNK, Collection
from fathomline.llm.common import bytes_of, discard, refuse_clashes, settle, shared_dir

SPAN = 200
GRAM = 40
BUFFER = 1 << 20  # bytes hashed at a time; positions take 20 bits
WORD = 8  # bytes of a symbol
FINEST = 8  # halvings that leave one place of the anchor
ROWS = 1 << 14  # segments of small anchors that share a collection
CROWD = 1 << 17  # segments of an anchor that make one collection
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
NAMES = ["h", "g", "k"]  # a segment's name: its anchor and two halves of its content's hash


def _contents(bodies: list[bytes], shapes: list[int], key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keyed hash of segments' bytes and shapes."""
    digests = [hashlib.blake2b(b, digest_size=16, key=key, salt=s.to_bytes(8, "little")).digest() for b, s in zip(bodies, shapes)]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(BUFFER + 1, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in each run of ``width``, from prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Cutter:
    """Bytes to anchored segments."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram, self.width = span, gram, span - gram + 1
        self.power, self.inverse = _powers()

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Buffers of ``(doc, start, bytes)``: whole texts, or parts of long ones that overlap by ``span - 1``."""
        held, size = [], 0
        room = BUFFER - self.span
        for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b - a < self.span:
                continue
            for at in range(a, b - self.span + 1, room):
                part = data[at : min(b, at + room + self.span - 1)]
                if size + len(part) > BUFFER:
                    yield held
                    held, size = [], 0
                held.append((doc, at - a, part))
                size += len(part)
        if held:
            yield held

    def segments(self, held):
        """Of a buffer: doc, start, run (windows), left (anchor's distance from start), anchor and bytes of each segment."""
        lengths = np.array([len(p) for _, _, p in held])
        text = np.concatenate([p for _, _, p in held])
        n, span, gram = len(text), self.span, self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * self.inverse[: n - gram + 1])
        keep = np.uint64(((1 << 44) - 1) << 20)
        least = _window_min((grams & keep) | np.arange(len(grams), dtype=np.uint64), self.width)
        where = (least & np.uint64(BUFFER - 1)).astype(np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        valid = np.zeros(n + 1, np.int8)  # marks windows within one piece
        np.add.at(valid, begins, 1)
        np.add.at(valid, ends - span + 1, -1)
        valid = np.cumsum(valid[:n], dtype=np.int8)[: len(where)].astype(bool)
        fresh = np.empty(len(where), bool)
        fresh[0] = True
        fresh[1:] = where[1:] != where[:-1]
        fresh[begins[begins < len(where)]] = True
        first = np.flatnonzero(fresh & valid)
        stop = np.concatenate((first[1:], [len(where)]))
        piece = np.searchsorted(ends, first, side="right")
        stop = np.minimum(stop, ends[piece] - span + 1)
        run = stop - first
        anchor = grams[where[first]]
        left = where[first] - first
        raw = text.tobytes()
        bodies = (raw[a:b] for a, b in zip(first.tolist(), (first + run - 1 + span).tolist()))
        doc = np.array([d for d, _, _ in held])[piece]
        start = first - begins[piece] + np.array([s for _, s, _ in held])[piece]
        return doc, start, run, left, anchor, bodies


def _cut(span: int, gram: int, key: bytes | None = None):
    """Texts to their segments, named under ``key``; without one, to their anchors."""

    def run(batches):
        cutter = _Cutter(span, gram)
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            seen = {}
            for held in cutter.pieces(data, offsets):
                doc, start, run_, left, anchor, bodies = cutter.segments(held)
                if key is None:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["h"])
                    continue
                for d, _, _ in held:
                    if d not in seen:
                        seen[d] = xxhash.xxh64_intdigest(data[offsets[d] : offsets[d + 1]], 42)  # as Spark's xxhash64
                digest = np.array([seen[d] for d in doc.tolist()], np.uint64)
                shape = left << 16 | run_
                content = _contents(bodies, shape.tolist(), key)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        *map(pa.array, content),
                        batch.column(0).take(pa.array(doc)),
                        pa.array(digest.view(np.int64)),
                        pa.array(start),
                        pa.array(shape.astype(np.int32)),
                    ],
                    [*NAMES, "id", "t", "start", "shape"],
                )

    return run


def _bytes_grid(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    """Symbols of segments whose first bytes are in ``column``: a row each, bytes plus 1 (UTF-8 has no 255), 0 past either end."""
    grid = np.zeros((len(column), columns), np.uint8)
    for a in range(0, len(column), ROWS):
        b = min(len(column), a + ROWS)
        size = offsets[a + 1 : b + 1] - offsets[a:b]
        row = np.repeat(np.arange(a, b), size)
        place = np.arange(len(row)) - np.repeat(offsets[a:b] - offsets[a], size) + np.repeat(column[a:b], size)
        grid[row, place] = data[offsets[a] : offsets[b]] + np.uint8(1)
    return grid.view(">u8").astype(np.uint64)


def _runs(build: Collection, least: int):
    """The suffixes of ``build`` in whole runs of ``least`` common symbols: run, symbol before, document and depth."""
    held, number = None, 0
    for symbol, common, doc, depth in build.blocks():
        run = np.cumsum(common < least, dtype=np.int64) + number
        number = int(run[-1]) if len(run) else number
        block = np.array([run, symbol, doc, depth], np.int64)
        held = block if held is None else np.concatenate([held, block], axis=1)
        cut = int(np.searchsorted(held[0], number))  # the last run may go on
        if cut:
            yield held[:, :cut]
            held = held[:, cut:]
    if held is not None and held.shape[1]:
        yield held


def repeated_windows(data, offsets, left, run, count, span=SPAN, gram=GRAM, chunk=CHUNK, place=None) -> np.ndarray:
    """``(segments, width)`` booleans: the windows of each segment that occur twice or more, counts included."""
    if span % WORD:
        raise ValueError(f"span is a multiple of {WORD}")
    width = span - gram + 1
    column = width - 1 - left
    flags = np.zeros((len(left), width), bool)
    if not len(left):
        return flags
    words = _bytes_grid(data, offsets, column, -(-(width - 1 + span) // WORD) * WORD)
    first, last = column // WORD, (column + run + span - 2) // WORD
    vocabulary, grid = np.unique(np.append(words, np.uint64(0)), return_inverse=True)  # 0 is the first
    grid = grid[:-1].reshape(words.shape).astype(np.int32)
    whole = span // WORD - 1  # symbols that a window holds wherever it begins
    build = Collection(grid, first, last, chunk, place)
    try:
        for group, symbol, doc, depth in _runs(build, whole):
            group = group - group[0]
            keep = (np.bincount(group, weights=count[doc])[group] >= 2) & (depth >= whole)
            group, doc, at = group[keep], doc[keep], (last[doc] - depth + 1)[keep]
            before, after = vocabulary[symbol[keep]], words[doc, np.minimum(at + whole, words.shape[1] - 1)]
            after[at + whole >= words.shape[1]] = 0
            for r in range(WORD):
                step = WORD * at - r - column[doc]
                mine = np.flatnonzero((step >= 0) & (step < run[doc]))
                if not len(mine):
                    continue
                rest = after[mine] if r == 0 else before[mine] << np.uint64(8 * (WORD - r)) | after[mine] >> np.uint64(8 * r)
                order = np.lexsort((rest, group[mine]))
                mine, rest = mine[order], rest[order]
                fresh = np.ones(len(mine), bool)
                fresh[1:] = (rest[1:] != rest[:-1]) | (group[mine[1:]] != group[mine[:-1]])
                equal = np.cumsum(fresh) - 1
                hit = mine[np.bincount(equal, weights=count[doc[mine]])[equal] >= 2]
                flags[doc[hit], step[hit]] = True
    finally:
        build.close()
    return flags


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in each row: row, first, last."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _build(span: int, gram: int, chunk: int, place: str):
    """Segments sorted by anchor to the ranges of their repeated windows."""

    def flush(table: pa.Table):
        table = table.combine_chunks()
        body = table.column("body").combine_chunks().cast(pa.large_binary())
        _, offsets, data = body.buffers()
        offsets = np.frombuffer(offsets, np.int64)[body.offset : body.offset + len(body) + 1]
        shape = table.column("shape").to_numpy()
        flags = repeated_windows(
            np.frombuffer(data, np.uint8), offsets, shape >> 16, shape & 0xFFFF, table.column("count").to_numpy(), span, gram, chunk, place
        )
        row, first, last = _ranges(flags)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                *(table.column(c).combine_chunks().take(at) for c in NAMES),
                pa.array(first.astype(np.int32)),
                pa.array(last.astype(np.int32)),
            ],
            [*NAMES, "first", "last"],
        )

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows -= cut
        if rows:
            yield flush(pa.Table.from_batches(held))

    return run


def _halve(span: int, gram: int, level: int, secret: bytes):
    """Segments to parts whose windows' anchor places lie in one of ``2 ** level`` ranges, dealt by the bytes that such windows share."""
    width = span - gram + 1
    size = -(-width // (1 << level))

    def run(batches):
        for batch in batches:
            rows = []
            for h, g, k, count, shape, body in zip(*(c.to_pylist() for c in batch.columns)):
                left, windows = shape >> 16, shape & 0xFFFF
                for part in range((left - windows + 1) // size, left // size + 1):
                    low, high = part * size, min(part * size + size - 1, width - 1)  # anchor places
                    begin, end = max(0, left - high), min(windows - 1, left - low)  # windows
                    key = body[left - low : left - high + span] if level < FINEST else body[begin : begin + span]
                    own = body[begin : end + span]
                    mark = f"{h} {level} {part}".encode()
                    new = (left - begin) << 16 | (end - begin + 1)
                    rows.append((xxhash.xxh64_intdigest(mark + key, 3), h, g, k, begin, count, new, own))
            kinds = (pa.uint64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            dealt, *columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            names = _contents([r[-1] for r in rows], [r[-2] for r in rows], secret)
            columns = [pa.array(dealt.to_numpy().view(np.int64)), *map(pa.array, names), *columns]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "up_h", "up_g", "up_k", "shift", "count", "shape", "body"])

    return run


def _hits(bodies: DataFrame, span: int, gram: int, crowd: int, chunk: int, key: bytes, level: int = 0) -> DataFrame:
    """``(h, g, k, first, last)``: the ranges of repeated windows of ``bodies(h, g, k, count, shape, body)``."""
    place = f"{shared_dir(bodies.sparkSession)}/tapes"
    build = _build(span, gram, chunk, place)
    kinds = "h long, g long, k long, first int, last int"
    crowds = settle(bodies.groupBy("h").count().where(F.col("count") > crowd).select("h"), "crowds")
    if level == FINEST or crowds.isEmpty():
        return bodies.repartition("h").sortWithinPartitions("h").mapInArrow(build, kinds)
    found = bodies.join(crowds, "h", "left_anti").repartition("h").sortWithinPartitions("h").mapInArrow(build, kinds)
    schema = "h long, g long, k long, up_h long, up_g long, up_k long, shift int, count long, shape int, body binary"
    crowded = bodies.join(crowds, "h", "left_semi").select(*NAMES, "count", "shape", "body")
    parts = settle(crowded.mapInArrow(_halve(span, gram, level + 1, key), schema), "parts")
    variants = parts.groupBy(*NAMES).agg(F.sum("count").alias("count"), F.any_value("shape").alias("shape"), F.any_value("body").alias("body"))
    finer = _hits(settle(variants, "variants"), span, gram, crowd, chunk, key, level + 1)
    back = parts.join(finer, NAMES).select(*[F.col(f"up_{c}").alias(c) for c in NAMES], (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    return found.unionByName(back)


def _extract(span: int):
    """Texts with the segments wanted of them to those segments' bytes."""

    def run(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            for row in range(batch.num_rows):
                wanted = batch.column(1)[row].values
                start = wanted.field("start").to_numpy(zero_copy_only=False) + offsets[row]
                shape = wanted.field("shape")
                size = (shape.to_numpy(zero_copy_only=False) & 0xFFFF) + span - 1
                body = pa.array([data[a : a + s].tobytes() for a, s in zip(start.tolist(), size.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(wanted.field(c) for c in NAMES), wanted.field("count"), shape, body], [*NAMES, "count", "shape", "body"]
                )

    return run


def _strip(ranges):
    """Texts with the starts and ends of removed strings to what is left."""

    def run(batches):
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            removed, spans, kept, digest = [], [], [], []
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                found = batch.column(2)[row]
                if found.is_valid and len(found.values):
                    a = found.values.field("a").to_numpy(zero_copy_only=False)
                    b = found.values.field("b").to_numpy(zero_copy_only=False)
                    mark = np.zeros(len(text) + 1, np.int32)
                    np.add.at(mark, a, 1)
                    np.add.at(mark, b, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    left = text[~gone].tobytes()
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                else:
                    left = text.tobytes()
                    removed.append(0)
                    spans.append(0)
                kept.append(left.decode("utf-8", "ignore") if ranges else None)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in (0, *range(3, batch.num_columns))),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept, pa.string()),
                ],
                [*(batch.schema.names[i] for i in (0, *range(3, batch.num_columns))), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``(id, t, a, b)``: byte ranges ``[a, b)`` of texts covered by repeated strings; ``t`` is a digest of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    anchors = rows.mapInArrow(_cut(span, gram), "h long").groupBy("h").count().where("count > 1").select("h")
    anchors = settle(anchors, "anchors")
    key = secrets.token_bytes(32)
    cut = rows.mapInArrow(_cut(span, gram, key), f"h long, g long, k long, id {kind}, t long, start long, shape int")
    found = settle(cut.join(anchors, "h", "left_semi"), "segments")
    variants = found.groupBy(*NAMES).agg(F.count("*").alias("count"), F.min(F.struct("id", "t", "start", "shape")).alias("one"))
    wanted = (
        variants.select("one.*", *NAMES, "count")
        .groupBy("id", "t")
        .agg(F.collect_list(F.struct("start", "shape", *NAMES, "count")).alias("wanted"))  # as many as a text has segments at most
    )
    texts = rows.where(F.octet_length("body") >= span).withColumn("t", _digest("body"))
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["t"] == wanted["t"])).select("body", "wanted", texts["id"], texts["t"])
    texts = texts.select("body", "wanted")
    bodies = settle(texts.mapInArrow(_extract(span), "h long, g long, k long, count long, shape int, body binary"), "bodies")
    hits = _hits(bodies, span, gram, crowd, chunk, key)
    hits = settle(hits.distinct(), "hits")
    discard(anchors)
    discard(bodies)
    return found.join(hits, NAMES).select(
        "id", "t", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + span).alias("b")
    )


def _digest(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    span: int = SPAN,
    gram: int = GRAM,
    crowd: int = CROWD,
    chunk: int = CHUNK,
) -> DataFrame:
    """Each text without the bytes that a repeated ``span``-byte string covers.

    Returns ``id_col``, the columns of ``keep``, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256`` (of the bytes that stay) and, if ``keep`` is given,
    ``kept_text`` (those bytes as text; parts of a cut character go). Strings are judged on
    the input; the same string starting twice in one text counts, and so do overlaps. A null
    text is empty; texts under ``span`` bytes stay whole; a repeated row repeats its text, so
    it loses all of a text of ``span`` bytes or more; null ids are ids like others; an empty
    table gives an empty result. Other columns are not looked at; a column of ``keep`` named as one of
    the result's is refused with a ValueError.
    """
    refuse_clashes([id_col, *(keep or []), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep is not None else [])])
    found = repeated_ranges(docs, id_col, text_col, span, gram, crowd, chunk)
    found = found.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("gone")).select(F.col("id").alias("i"), "t", "gone")
    extra = [docs[c].alias(f"keep_{n}") for n, c in enumerate(keep or [])]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"), _digest(docs[text_col]).alias("d"), *extra)
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("d") == F.col("t")), "left")
    names = [f"keep_{n}" for n in range(len(extra))]
    rows = rows.select("id", "body", "gone", *names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{n} {kinds[n]}" for n in ("id", *names)])
    out = rows.mapInArrow(_strip(keep is not None), f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(n).alias(c) for n, c in zip(names, keep or [])],
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept_sha256",
        *(["kept_text"] if keep is not None else []),
    )
