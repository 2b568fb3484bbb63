"""Token counts of a text's sections, from one encoding of the whole text.

Ids of a byte-level vocabulary are strings of bytes, so running sums of their lengths give each token's
byte span and, by the text's character starts, its character span (a token of part of a character
spans that character). The sorted spans are joined to the sorted sections by their ends. A token
within one section is its; one that crosses a boundary goes by an explicit rule:

* ``most``: to the section with most of its characters, the earlier one if equal;
* ``first``: to the section of its first character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.packing import Encoder, public_encoder

RULES = ("most", "first")


def line_sections(text: str) -> np.ndarray:
    """Where each line begins, line ends included in their lines, and the text's length."""
    ends = [0]
    at = text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if ends[-1] < len(text) or len(ends) == 1:
        ends.append(len(text))
    return np.array(ends)


class Spans:
    def __init__(self, encoder: Encoder):
        import base64

        self.encoder = encoder
        with open(encoder.ranks, "rb") as lines:
            sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, lines)}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 2)])

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character, and the one after the last, of each token."""
        ids = np.frombuffer(self.encoder.encode_plain(text), "<u4")
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[begins], character[ends - 1] + 1


def attribute(begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary; ``edges`` are the sections' ends in order, from 0."""
    first = np.searchsorted(edges, begins, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    crosses = first != last
    if rule == "most":
        for n in np.flatnonzero(crosses):
            own = np.arange(first[n], last[n] + 1)
            shared = np.minimum(edges[own + 1], ends[n]) - np.maximum(edges[own], begins[n])
            first[n] = own[shared.argmax()]
    return first, crosses


def _count(encoder, sections, rule: str):
    def run(batches):
        spans = Spans(encoder())
        names = ["place", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
        for batch in batches:
            parts = [[] for _ in names]
            for n, text in enumerate(batch.column(1)):
                body = text.as_py() or ""
                edges = sections(body)
                k = len(edges) - 1
                tokens = crossing = np.zeros(k, np.int64)
                if body:
                    where, crosses = attribute(*spans.of(body), edges, rule)
                    tokens = np.bincount(where, minlength=k)
                    crossing = np.bincount(where[crosses], minlength=k)
                for part, values in zip(parts, (np.full(k, n), np.arange(k), edges[:-1], edges[1:], tokens, crossing)):
                    part.append(values)
            flat = [pa.array(np.concatenate(p).astype(np.int64) if p else [], pa.int64()) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(flat[0]), *flat[1:]], ["id", *names[1:]])

    return run


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections=line_sections, rule: str = "most", encoder=public_encoder
) -> DataFrame:
    """Tokens of each section of each whole text.

    Returns ``id_col``, ``section`` (from 0), ``start_char``, ``end_char``, ``n_tokens`` and ``n_crossing`` (those of its tokens
    that cross a boundary). A text's counts sum to its tokens. A null or empty text is one empty section;
    an empty line is a section of its line end; null ids and repeated rows are kept; other columns are not
    looked at; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_count(encoder, sections, rule), f"id {kind}, section long, start_char long, end_char long, n_tokens long, n_crossing long")
    return out.withColumnRenamed("id", id_col)
