"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton holds the vocabulary's pieces. Going through a text once, at each position its
output links give every piece that ends there, longest first; each relaxes the position's best
score. A character that no piece covers costs ten below the least score and becomes its bytes' pieces.

The scores are taken as unigram scores whatever trained them, as the library's unigram model
would: for a file of merges the result is the best-scoring segmentation, not the order of merges.
Where no piece has the space mark after another character, text splits before each run of marks
without changing the result, and the parts' ids are remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # fixed value: stands for a space
UNKNOWN_PENALTY = 10.0  # fixed value: an uncovered character scores so much under the least piece
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces
MEMO = 200_000
NEVER = float("-inf")
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes):
    """``(number, value)`` of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class _Memo(dict):
    """Ids of parts of texts, made when first asked for; long parts are not kept."""

    def __init__(self, viterbi):
        super().__init__()
        self.viterbi = viterbi

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.viterbi(part)[0], np.uint32).tobytes()
        if len(part) < 64:
            self[part] = ids
        return ids


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.squeeze, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry[1].decode())
                self.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.kinds.append(entry.get(3, NORMAL))
            elif number == 3:
                entry = dict(_fields(value))
                charsmap = entry.get(2, b"")
                self.prefix, self.squeeze = bool(entry.get(3, 1)), bool(entry.get(4, 1))
        if charsmap:
            raise ValueError("vocabularies that normalise characters are not supported")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.least = min(s for s, k in zip(self.scores, self.kinds) if k == NORMAL) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        self.splits = True
        top = max(s for s, k in zip(self.scores, self.kinds) if k == NORMAL)
        for i, (piece, score, kind) in enumerate(zip(self.pieces, self.scores, self.kinds)):
            if kind in (NORMAL, USER):
                self.trie.add_word(piece, (len(piece), score if kind == NORMAL else len(piece) * top - 0.1, i))
                self.splits &= MARK not in piece.lstrip(MARK)
        self.trie.make_automaton()
        self.single = {p for p, k in zip(self.pieces, self.kinds) if k == NORMAL and len(p) == 1}
        other = {BYTE: lambda i: bytes([self.values[i]]), UNKNOWN: lambda i: " ⁇ ".encode(), CONTROL: lambda i: b""}
        self.spelled = [other[k](i) if k in other else p.encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        # a bare character's cost stands at the first of its bytes
        lead = lambda i: self.least if (self.values[i] & 0xC0) != 0x80 else 0.0
        self.weights = np.array([lead(i) if k == BYTE else self.least if k == UNKNOWN else s for i, (s, k) in enumerate(zip(self.scores, self.kinds))])
        self.memo = _Memo(self.viterbi)

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """The best ids of a normalised text and their score."""
        n = len(text)
        if self.single.issuperset(text):  # every position is reached by a piece
            best = [NEVER] * n
            best.append(0.0)  # at index -1: before the first character
            last = [0] * n
            for end, (size, score, piece) in self.trie.iter(text):
                total = best[end - size] + score
                if total > best[end]:
                    best[end], last[end] = total, piece
            ids, at, pieces = [], n - 1, self.pieces
            while at >= 0:
                ids.append(last[at])
                at -= len(pieces[last[at]])
            return ids[::-1], best[n - 1] if n else 0.0
        best = [0.0] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        reached, least = 0, self.least
        for end, (size, score, piece) in self.trie.iter(text):
            end += 1
            while reached < end:  # before any piece, the bare character
                reached += 1
                best[reached], back[reached] = best[reached - 1] + least, (reached - 1, -1)
            start = end - size
            total = best[start] + score
            if back[end][1] < 0 and size == 1 or total > best[end]:  # a piece of one character replaces the bare one
                best[end], back[end] = total, (start, piece)
        while reached < n:
            reached += 1
            best[reached], back[reached] = best[reached - 1] + least, (reached - 1, -1)
        ids, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:at].encode())]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1], best[n]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(text.split(" ")).strip(" ")
            text = re.sub(" +", " ", text)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        line = self.normalise(text)
        if self.splits:
            if len(self.memo) > MEMO:
                self.memo.clear()
            ids = np.frombuffer(b"".join(map(self.memo.__getitem__, PARTS.findall(line))), np.uint32)
        else:
            ids = np.array(self.viterbi(line)[0], np.uint32)
        return ids, float(self.weights[ids].sum())

    def decode(self, ids) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def public_path() -> str:
    import public_tokenizers as files

    return files.path("piece_bpe_32k.model")


def _encode(path, keep_ids: bool):
    def run(batches):
        vocabulary = Vocabulary(path())
        byte_ids = np.array(sorted(vocabulary.bytes.values()), np.uint32)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                body = text.as_py() or ""
                ids, score = vocabulary.encode(body)
                plain = ids.astype("<u4")
                # a text that holds the mark itself, or squeezed spaces, comes back with spaces
                same = vocabulary.decode(ids.tolist()) == body
                rows.append((len(ids), zlib.crc32(plain.tobytes()), int(np.isin(ids, byte_ids).sum()), score, same, plain.tobytes() if keep_ids else None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_ids", "ids_crc32", "n_byte_ids", "score", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path=public_path, keep_ids: bool = False) -> DataFrame:
    """Each whole text's best segmentation.

    Returns ``id_col``, ``n_ids``, ``ids_crc32`` (unsigned, of little-endian unsigned 32-bit ids), ``n_byte_ids``,
    ``score`` and ``round_trip`` (decoding gives the text), and with ``keep_ids`` the ``ids``. Null and empty texts
    have no ids and score 0 (a null text counts as empty); of equally good segmentations the one whose last
    piece is longest wins; null ids and repeated rows are kept; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_encode(path, keep_ids), f"id {kind}, n_ids long, ids_crc32 long, n_byte_ids long, score double, round_trip boolean, ids binary")
    out = out.withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path=public_path) -> DataFrame:
    """``rows`` with the text of little-endian unsigned 32-bit ids in ``text_col``; null ids give null, no ids the empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(path())
        for ids in batches:
            yield ids.map(lambda x: None if x is None else vocabulary.decode(np.frombuffer(x, "<u4").tolist()))

    return rows.withColumn(text_col, text(F.col(ids_col)))
