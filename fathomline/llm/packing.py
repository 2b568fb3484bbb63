"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal classes: class ``k`` holds pieces that fit ``k`` to a sequence,
so up to ``capacity // k`` tokens, and each of its bins takes exactly ``k`` pieces. Classes and
workers fill their bins independently: nothing but unfilled bins leaves a worker.

As documents may be cut, a document becomes whole sequences, then pieces of reciprocal
size, until the rest nearly fills its class. Pieces of unfilled bins (under ``k`` for each
class and worker) meet in ever fewer tasks that fill bins likewise; what the last one has left is laid
end to end, and its last sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import settle

CAPACITY = 2048
END = 1
SLACK = 64  # a piece may leave a SLACK-th of its share unfilled
FAN = 64  # tasks whose unfilled bins meet in one
SPECIAL = "<|endoftext|>"
LONG = 50_000  # a run of so much white space is taken out of the pattern's way
RUN = regex.compile(r"\p{White_Space}{%d,}" % LONG)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as the tokenizer file's library gives them.

    The ranks are the same vocabulary for a faster library; a text that names the special
    token goes to the file's own library. The pattern's look-ahead recurs over a run of white
    space, so a long run is split as the pattern would split it: all but its last
    character (all, at the end of the text) is one part, and the last one begins the rest.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.by_pattern = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.as_one = tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.tokenizer, self.ranks, self.library = tokenizer, ranks, None

    def encode_ordinary(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.by_pattern(text)
        ids, at = [], 0
        for run in RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.by_pattern(text[at : run.start()]) + self.as_one(text[run.start() : end])
            at = end
        return ids + self.by_pattern(text[at:])

    def encode_plain(self, text: str) -> bytes:
        """Ids that spell out the text's bytes: the special token's name is ordinary text here."""
        return np.array(self.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if SPECIAL not in text:
            return np.array(self.encode_ordinary(text), "<u4").tobytes()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.tokenizer)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def public_encoder() -> Encoder:
    import public_tokenizers as files

    return Encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def cut_lengths(total: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """``(class, length)`` of a document's pieces in order."""
    pieces = [(1, capacity)] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        if (capacity // k - rest) * slack <= rest:
            pieces.append((k, rest))
            break
        size = capacity // (k + 1)
        pieces.append((k + 1, size))
        rest -= size
    return pieces


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "k", "ids"]


class _Bins:
    """Fills bins of each class; rows of full bins come out, the rest stays in ``open``."""

    def __init__(self, capacity: int, level: int, keep_ids: bool):
        self.capacity, self.keep_ids = capacity, keep_ids
        self.next = level << 56 | TaskContext.get().partitionId() << 32
        self.open, self.rows = defaultdict(list), []

    def add(self, k: int, piece: tuple) -> None:
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length, crc, total, ids in pieces:
            self.rows.append((doc, start, length, crc, total, self.next, offset, None, ids if self.keep_ids else None))
            offset += length
        self.next += 1

    def unfilled(self) -> None:
        for k, pieces in self.open.items():
            self.rows += [(doc, start, length, crc, total, None, None, k, ids) for doc, start, length, crc, total, ids in pieces]
        self.open.clear()

    def lay(self) -> None:
        """All unfilled pieces end to end, cut anew."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        room, held = self.capacity, []
        left = sum(p[2] for p in pieces)
        sizes = [self.capacity] * (left // self.capacity) + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left % self.capacity >> b & 1]
        sizes.reverse()
        room = sizes.pop() if sizes else 0
        for doc, start, length, _, total, ids in pieces:
            at = 0
            while at < length:
                size = min(room, length - at)
                part = ids[4 * at : 4 * (at + size)]
                held.append((doc, start + at, size, zlib.crc32(part), total, part))
                at += size
                room -= size
                if not room:
                    self.close(held)
                    held, room = [], sizes.pop() if sizes else 0

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema(list(zip(FIELDS, [kind, long, long, long, long, long, long, pa.int32(), pa.binary()])))


def _first(capacity: int, slack: int, end: int, keep_ids: bool, encoder):
    def run(batches):
        coder = encoder()
        last = np.array([end], "<u4").tobytes()
        bins = schema = None
        for batch in batches:
            bins = bins or _Bins(capacity, 0, keep_ids)
            schema = schema or _schema(batch.schema.types[0])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = coder.encode(text.as_py() or "") + last
                total, start = len(ids) // 4, 0
                for k, length in cut_lengths(total, capacity, slack):
                    part = ids[4 * start : 4 * (start + length)]
                    bins.add(k, (doc, start, length, zlib.crc32(part), total, part))
                    start += length
                if len(bins.rows) > 20_000:
                    yield bins.batch(schema)
        if bins:
            bins.unfilled()
            yield bins.batch(schema)

    return run


def _again(capacity: int, level: int, final: bool, keep_ids: bool):
    def run(batches):
        bins = schema = None
        for batch in batches:
            bins = bins or _Bins(capacity, level, keep_ids)
            schema = schema or _schema(batch.schema.types[0])
            cols = [batch.column(FIELDS.index(c)).to_pylist() for c in ("k", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")]
            for k, *piece in zip(*cols):
                bins.add(k, tuple(piece))
            if bins.rows:
                yield bins.batch(schema)
        if bins:
            bins.lay() if final else bins.unfilled()
            yield bins.batch(schema)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: int = SLACK,
    end: int = END,
    keep_ids: bool = False,
    encoder=public_encoder,
) -> DataFrame:
    """Pack each text's ids and then ``end`` into sequences of at most ``capacity`` ids.

    Returns a row for each piece: ``id_col``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence, gapless from
    0) and, with ``keep_ids``, ``ids`` (little-endian unsigned 32-bit). Each id lies in one piece.
    Null and empty texts are the single id ``end``; a null id or a repeated row is packed
    like any other; long texts are cut; an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, k int, ids binary"
    now = settle(rows.mapInArrow(_first(capacity, slack, end, keep_ids, encoder), schema), "pieces")
    tasks = max(1, len(now.inputFiles()))  # one for each task that wrote
    done, level = [], 0
    while True:
        done.append(now.where("k is null"))
        tasks, level = -(-tasks // FAN), level + 1
        final = tasks == 1
        now = settle(now.where("k is not null").repartition(tasks).mapInArrow(_again(capacity, level, final, keep_ids), schema), "pieces")
        if final:
            done.append(now)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumnRenamed("doc_id", id_col).drop("k")
    return out if keep_ids else out.drop("ids")
