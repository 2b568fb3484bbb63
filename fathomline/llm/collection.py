"""The Burrows-Wheeler transform of many documents, built column by column.

Documents are strings of symbols. Round ``t`` inserts one symbol of each: the suffix of ``t + 1`` symbols goes into the
order of all suffixes so far. Its place follows from the transform: suffixes that begin with smaller symbols come
before it, and of those with its own symbol as many as that symbol occurs in the transform ahead of the suffix it
extends. Its common prefix with the one before is one more than the least common prefix since that symbol's last
occurrence. So a round reads the transform, the prefixes and the suffixes' names once in order and writes them once in
order; what it holds besides is a few numbers for each document.

These three columns are ``Tape`` s: in memory while they are short, else files written and read in sequence.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs

CHUNK = 1 << 20  # entries in memory at a time
DEPTHS = 256  # symbols of a document, at most one less


class Tape:
    """Numbers appended in order and read in order; a file of ``place`` once there are more than ``room``."""

    def __init__(self, kind, room: int, place: str | None):
        self.kind, self.room, self.place = np.dtype(kind), room, place
        self.parts, self.rows, self.out, self.name = [], 0, None, None

    def put(self, values: np.ndarray) -> None:
        self.rows += len(values)
        self.parts.append(np.ascontiguousarray(values, self.kind))
        if self.place is not None and self.rows > self.room:
            if self.out is None:
                fs, folder = pyarrow.fs.FileSystem.from_uri(self.place)
                fs.create_dir(folder)
                self.name = f"{folder}/{uuid.uuid4().hex}"
                self.fs, self.out = fs, fs.open_output_stream(self.name)
            for part in self.parts:
                self.out.write(part)
            self.parts = []

    def reader(self):
        """A function that gives the next so many numbers."""
        if self.out is not None:
            self.out.close()
            stream = self.fs.open_input_stream(self.name)
            return lambda n: np.frombuffer(stream.read(n * self.kind.itemsize), self.kind)
        whole, at = (self.parts[0] if len(self.parts) == 1 else np.concatenate([np.zeros(0, self.kind), *self.parts])), 0

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return whole[at - n : at]

        return take

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.name)
        self.parts = []


def low_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima over runs of 1, 2, 4, ... values."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def range_min(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in range(len(table)):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[k][first[mine]], table[k][last[mine] - (1 << k) + 1])
    return out


class Collection:
    """The transform of documents ``grid[i, first[i] .. last[i]]``; symbols are positive, and smaller ones sort first."""

    def __init__(self, grid: np.ndarray, first: np.ndarray, last: np.ndarray, chunk: int = CHUNK, place: str | None = None):
        self.grid, self.first, self.last, self.chunk, self.place = grid, first, last, chunk, place
        if grid.shape[1] >= DEPTHS:
            raise ValueError(f"a document has fewer than {DEPTHS} symbols")
        self.n = len(grid)
        self.names = np.int64 if self.n * DEPTHS > np.iinfo(np.int32).max else np.int32
        self.counts = np.zeros(int(grid.max(initial=0)) + 1, np.int64)
        docs = np.arange(self.n)
        start = self._ahead(docs, 0)
        self.counts += np.bincount(start, minlength=len(self.counts))
        self._hold(self._tapes(), [start, np.zeros(self.n, np.uint8), docs * DEPTHS])
        self.docs, self.places = docs, docs  # the newest suffixes in order
        depth = 0
        while self._round(depth):
            depth += 1

    def _tapes(self) -> list[Tape]:
        return [Tape(kind, self.chunk, self.place) for kind in (np.int32, np.uint8, self.names)]

    def _hold(self, tapes: list[Tape], values: list[np.ndarray] = ()) -> None:
        for tape, column in zip(tapes, values):
            tape.put(column)
        self.transform, self.common, self.entries = tapes

    def _ahead(self, docs: np.ndarray, depth: int) -> np.ndarray:
        """The symbol before each document's suffix of ``depth`` symbols, 0 if that is the whole."""
        column = self.last[docs] - depth
        return np.where(column >= self.first[docs], self.grid[docs, np.maximum(column, 0)], 0)

    def _round(self, depth: int) -> bool:
        symbol = self._ahead(self.docs, depth)
        docs, places, symbol = self.docs[symbol > 0], self.places[symbol > 0], symbol[symbol > 0]
        if not len(docs):
            return False
        seen = self.counts.copy()
        seen[0] = 0  # nothing comes before a whole document
        piles = self.n + np.cumsum(seen) - seen  # where each symbol's suffixes begin
        rank, value, changed, changes = self._ranks(places, symbol, piles)
        target = piles[symbol] + rank
        order = np.argsort(target)
        docs, target, value = docs[order], target[order], value[order]
        ahead = self._ahead(docs, depth + 1)
        new = self._tapes()
        self._merge(new, target, [ahead, value, docs * DEPTHS + depth + 1], changed, changes)
        self.close()
        self._hold(new)
        self.counts += np.bincount(ahead, minlength=len(self.counts))
        self.docs, self.places = docs, target
        return True

    def _ranks(self, places: np.ndarray, symbol: np.ndarray, piles: np.ndarray):
        """For the newest suffixes at ``places``: how often ``symbol`` occurs ahead, and the extended suffix's common prefix; then other suffixes' places and common prefixes that these change."""
        known = np.unique(symbol)
        slot = np.full(len(self.counts), -1, np.int32)
        slot[known] = np.arange(len(known))
        got, low = np.zeros(len(known), np.int64), np.full(len(known), 255, np.uint8)
        ranks, values = np.empty(len(places), np.int64), np.empty(len(places), np.uint8)
        changed, changes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        transform, common = self.transform.reader(), self.common.reader()
        for a in range(0, self.transform.rows, self.chunk):
            size = min(self.chunk, self.transform.rows - a)
            slots, prefix = slot[transform(size)], common(size)
            here = np.flatnonzero(slots >= 0)
            if len(here):
                by = here[np.argsort(slots[here], kind="stable")]
                mine = slots[by]
                head = np.concatenate(([True], mine[1:] != mine[:-1]))
                heads = np.flatnonzero(head)
                sizes = np.diff(np.append(heads, len(by)))
                rank = got[mine] + np.arange(len(by)) - np.repeat(heads, sizes)
                begin = np.concatenate(([0], by[:-1] + 1))
                begin[head] = 0
                least = range_min(low_table(prefix), begin, by)
                least[heads] = np.minimum(least[heads], low[mine[heads]])
                value = np.where(rank > 0, np.minimum(least, 254) + np.uint8(1), 0).astype(np.uint8)
                where = np.searchsorted(places, a + by)
                fresh = places[np.minimum(where, len(places) - 1)] == a + by
                ranks[where[fresh]], values[where[fresh]] = rank[fresh], value[fresh]
                changed.append(piles[known[mine[~fresh]]] + rank[~fresh])
                changes.append(value[~fresh])
                low = np.minimum(low, prefix.min())
                after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(255))
                low[mine[heads]] = after[by[heads + sizes - 1] + 1]
                got[mine[heads]] += sizes
            else:
                low = np.minimum(low, prefix.min())
        changed, changes = np.concatenate(changed), np.concatenate(changes)
        order = np.argsort(changed)
        return ranks, values, changed[order], changes[order]

    def _merge(self, new: list[Tape], target: np.ndarray, values: list[np.ndarray], changed: np.ndarray, changes: np.ndarray) -> None:
        """Old columns with ``values`` at ``target``, in order, into ``new``."""
        total = self.transform.rows + len(target)
        for tape, old, fresh in zip(new, (self.transform, self.common, self.entries), values):
            take = old.reader()
            for a in range(0, total, self.chunk):
                b = min(total, a + self.chunk)
                i, j = np.searchsorted(target, (a, b))
                block, mark = np.empty(b - a, tape.kind), np.ones(b - a, bool)
                mark[target[i:j] - a] = False
                block[mark] = take(b - a - (j - i))
                block[target[i:j] - a] = fresh[i:j]
                if old is self.common:
                    i, j = np.searchsorted(changed, (a, b))
                    block[changed[i:j] - a] = changes[i:j]
                tape.put(block)

    def blocks(self):
        """``(transform, common, document, depth)`` of the suffixes in order, a chunk at a time."""
        readers = [t.reader() for t in (self.transform, self.common, self.entries)]
        for a in range(0, self.transform.rows, self.chunk):
            symbol, common, entry = (take(min(self.chunk, self.transform.rows - a)) for take in readers)
            yield symbol, common, entry // DEPTHS, entry % DEPTHS

    def close(self) -> None:
        for tape in (self.transform, self.common, self.entries):
            tape.close()
