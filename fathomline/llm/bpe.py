"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one small database a task.

A text is cut into words by the vocabulary's pattern. The distinct words of some texts become rows of
token positions; in a recursive query these rows meet the merge table, the leftmost pair of least rank of
each word is contracted, and words that have no pair left stop. A word that is itself a token is that token,
as in the rank file's own library. Ids go back to bytes by an ordered aggregation over their spellings.

Words beyond ``LONG`` bytes would need a round a pair, so each of their rounds contracts every occurrence of the
least pair, left to right. That is the same as one by one if no pair that arises is due before it: least ranks must rise from
round to round, which each round checks (a word that breaks it is done again pair by pair), and pairs that may arise between
two occurrences are known from the vocabulary (``safe``; others go leftmost first). Rounds go in several queries of bounded size.

What a task remembers of words changes speed only, and is dropped when it has grown large.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 64  # bytes of a word that takes the way of long words
PIECE = 1 << 20  # characters of texts cut and encoded together
KEPT = 400_000  # words that a task remembers
HELD = 1 << 21  # rows that the rounds of one query may leave
END = (1 << 24) - 1  # stands after a word's last token
OTHER, LETTER, NUMBER, SPACE = range(4)
BLANK, QUOTE = ord(" "), ord("'")
#: What a quote may open as a word of its own.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

#: One round: rows (w, p, a, b) hold a word's token a at place p and the token b after it. The pair at q becomes
#: t: the row at q goes, the one after it now begins with t, the one before it ends with t, and later places move up.
ROUNDS = """with recursive s(w, p, a, b, k) as (
  select w, p, a, b, 0 from base
  union all
  select s.w, s.p - cast(s.p > q as int), case when s.p = q + 1 then t else a end, case when s.p = q - 1 then t else b end, k + 1
  from s join (select w, cast(v & 16777215 as int) as q, cast(v >> 24 as int) as t
               from (select w, min((cast(m.t as bigint) << 24) + p) as v from s join merges m on m.ab = (cast(s.a as bigint) << 24) + s.b group by w)) least using (w)
  where s.p <> q and k < {rounds}),
last as (select w, max(k) as k from s group by w)
select w, p, a, b, k from s join last using (w, k) order by w, p"""

#: A round of all occurrences of a word's least pair; of overlapping ones every second counts. Ranks must rise from ``floor``.
ALL_ROUNDS = """with recursive s(w, p, a, b, floor, k) as (
  select w, p, a, b, floor, 0 from base
  union all
  select w, cast(p - coalesce(before, 0) as int), case when prior then t else a end, case when later then t else b end, t, k + 1
  from (select w, p, a, b, t, k, cut,
               sum(cast(cut as int)) over (partition by w order by p rows between unbounded preceding and 1 preceding) as before,
               coalesce(lag(cut) over (partition by w order by p), false) as prior,
               coalesce(lead(cut) over (partition by w order by p), false) as later
        from (select *, hit and (p - min(p) over (partition by w, hit, isle)) % 2 = 0 and (safe or p = min(p) over (partition by w, hit)) as cut
              from (select * exclude (safe), p - row_number() over (partition by w, hit order by p) as isle, bool_and(coalesce(safe or not hit, true)) over (partition by w) as safe
                    from (select s.w, s.p, s.a, s.b, s.k, least.t, m.safe, coalesce(m.t = least.t, false) as hit
                          from s join (select w, min(m.t) as t from s join merges m on m.ab = (cast(s.a as bigint) << 24) + s.b group by w having min(m.t) > max(floor)) least using (w)
                          left join merges m on m.ab = (cast(s.a as bigint) << 24) + s.b where s.k < {rounds}))))
  where not cut),
last as (select w, max(k) as k from s group by w)
select w, p, a, b, floor, k from s join last using (w, k) order by w, p"""

DECODE = """select w, unhex(string_agg(spelled, '' order by p)) as body from given join tokens using (a) group by w order by w"""


def public_path() -> str:
    import public_tokenizers as files

    return files.path("byte_bpe_50k.tiktoken")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            low, high = ord(every[run.start()]), ord(every[run.end() - 1])
            table[low : high + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def word_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts end to end, where their words begin and how many words each has.

    The same words as by the public pattern: runs of letters, of numbers and of others, each with a blank before it if
    there is one; white space otherwise, but for its last character before another word; ``SUFFIXES`` after a quote.
    """
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = len(codes)
    if not n:
        return whole, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, bool)  # a text begins here
    ends = np.cumsum(sizes)
    edge[ends - sizes] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1  # words that white space precedes
    start[after - 1] = True
    start[after[codes[after - 1] == BLANK]] = False
    quotes = np.flatnonzero(start & (codes == QUOTE))
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(3, np.uint32)])
        limit = ends[np.searchsorted(ends, quotes, side="right")]  # the text's end
        for suffix in SUFFIXES:
            fits = quotes + len(suffix) < limit
            for i, c in enumerate(suffix):
                fits &= padded[quotes + 1 + i] == ord(c)
            at = quotes[fits]
            start[at + 1] = False
            stop = at + 1 + len(suffix)
            start[stop[stop < n]] = True
    found = np.flatnonzero(start)
    counts = np.searchsorted(found, ends) - np.searchsorted(found, ends - sizes)
    return whole, found, counts


class _Memo(dict):
    """Numbers of keys met so far and, by number, their values: one growing array and its offsets.

    ``look_up`` gives numbers, new keys' too; their values are then added in the order of ``fresh``. Beyond ``KEPT``
    keys the rarer ones are forgotten.
    """

    def __init__(self, dtype):
        super().__init__()
        self.fresh: list = []
        self.flat, self.offsets = np.zeros(0, dtype), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number

    def look_up(self, keys, n: int) -> np.ndarray:
        if len(self) > KEPT:
            self._forget()
        numbers = np.fromiter(map(self.__getitem__, keys), np.int64, n)
        uses = np.bincount(numbers, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return numbers

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])
        self.fresh.clear()

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.offsets[numbers]
        size = self.offsets[numbers + 1] - begin
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        return self.flat[np.arange(len(shift)) + shift], size

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
        keys = list(self)
        flat, sizes = self.take(stay)
        self.clear()
        self.update((keys[i], n) for n, i in enumerate(stay.tolist()))
        self.flat, self.offsets = flat, np.concatenate([[0], np.cumsum(sizes)])
        self.uses = self.uses[stay] >> 1  # what was frequent long ago gives way


class Codec:
    """A vocabulary of ranks in a DuckDB database of its own."""

    def __init__(self, path: str, long: int = LONG, held: int = HELD):
        self.long, self.held = long, held
        self.ranks = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.partition(b" ")
                if rank.strip():
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        listed = pa.table({"a": pa.array(self.ranks.values(), pa.int32()), "spelled": pa.array([t.hex() for t in self.ranks], pa.string())})
        self._put("listed", listed)
        self.db.execute("create table tokens as select * from listed")
        self.db.execute(
            """create table pairs as select (cast(l.a as bigint) << 24) + r.a as ab, t from
            (select a as t, left(spelled, 2 * k) as x, substr(spelled, 2 * k + 1) as y from tokens, unnest(range(1, length(spelled) // 2)) u(k))
            join tokens l on l.spelled = x join tokens r on r.spelled = y"""
        )
        # contracting all at once passes over the pair of t and what begins the next t, which must not be due before t
        self.db.execute(
            """create table merges as select ab, t, not exists (select 1 from pairs n where n.ab = (cast(m.t as bigint) << 24) + (m.ab >> 24) and n.t < m.t) as safe from pairs m"""
        )
        self.single = np.full(256, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        if (self.single < 0).any():
            raise ValueError("a vocabulary must hold all single bytes")
        top = max(self.ranks.values()) + 1
        self.leads = np.zeros(top, bool)  # tokens that begin with an ASCII character other than a letter
        for token, rank in self.ranks.items():
            self.leads[rank] = token[0] < 128 and not token[:1].isalpha()
        self.valid = np.zeros(top, bool)
        self.valid[list(self.ranks.values())] = True
        self.words, self.parts = _Memo(np.int32), _Memo(np.uint8)

    def _put(self, name: str, table: pa.Table) -> None:
        self.db.register(name, table)

    def _base(self, words: list[bytes]) -> pa.Table:
        data = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(x) for x in words], np.int64)
        ends = np.cumsum(n)
        a = self.single[data]
        b = np.append(a[1:], END).astype(np.int32)
        b[ends - 1] = END
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        return pa.table({"w": w, "p": (np.arange(len(data)) - np.repeat(ends - n, n)).astype(np.int32), "a": a, "b": b})

    def _fixpoint(self, base: pa.Table, every: bool) -> pa.Table:
        """All rounds; queries of so many rounds that their rows stay bounded follow each other."""
        done = []
        if every:
            base = base.append_column("floor", pa.array(np.full(len(base), -1, np.int32)))
        while len(base):
            rounds = max(1, self.held // len(base))
            self._put("base", base)
            now = self.db.sql((ALL_ROUNDS if every else ROUNDS).format(rounds=rounds)).to_arrow_table()
            more = now["k"].to_numpy() >= rounds
            done.append(now.filter(pa.array(~more)).select(["w", "p", "a", "b"]))
            base = now.filter(pa.array(more)).drop_columns(["k"])
        return pa.concat_tables(done).sort_by([("w", "ascending"), ("p", "ascending")])

    def merge(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of words and their counts; words are numbered in order."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        found = np.array([self.ranks.get(x, -1) for x in words], np.int32)
        sizes = np.array([len(x) for x in words])
        out_w, out_a = [np.flatnonzero(found >= 0)], [found[found >= 0]]
        every = (sizes > self.long) & (found < 0)
        plain = np.flatnonzero((found < 0) & ~every)
        for at in np.flatnonzero(every).tolist():
            rows = self._fixpoint(self._base([words[at]]), True)
            self._put("rows", rows)
            if self.db.execute("select exists (select 1 from rows join merges on ab = (cast(a as bigint) << 24) + b)").fetchall()[0][0]:
                rows = self._fixpoint(self._base([words[at]]), False)
            out_w.append(np.full(len(rows), at))
            out_a.append(rows["a"].to_numpy())
        if len(plain):
            rows = self._fixpoint(self._base([words[i] for i in plain]), False)
            out_w.append(plain[rows["w"].to_numpy()])
            out_a.append(rows["a"].to_numpy())
        w, a = np.concatenate(out_w), np.concatenate(out_a)
        order = np.argsort(w, kind="stable")
        return a[order].astype(np.int32), np.bincount(w, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and how many each has."""
        whole, starts, counts = word_starts(texts)
        bounds = np.append(starts, len(whole)).tolist()
        numbers = self.words.look_up([whole[i:j] for i, j in zip(bounds, bounds[1:])], len(starts))
        if self.words.fresh:
            self.words.add(*self.merge([x.encode("utf-8", "surrogatepass") for x in self.words.fresh]))
        ids, size = self.words.take(numbers)
        before = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        return ids, before[ends] - before[ends - counts]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids spell, end to end, and how many each list has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.valid) or not self.valid[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        ids = np.ascontiguousarray(ids, np.int32)
        start = self.leads[ids]  # parts of few tokens, so that few are distinct
        ends = np.cumsum(counts)
        begins = (ends - counts)[counts > 0]
        start[begins] = True
        found = np.flatnonzero(start)
        data, bounds = ids.tobytes(), (np.append(found, len(ids)) * 4).tolist()
        numbers = self.parts.look_up([data[i:j] for i, j in zip(bounds, bounds[1:])], len(found))
        if self.parts.fresh:
            a = np.frombuffer(b"".join(self.parts.fresh), np.int32)
            n = np.array([len(x) // 4 for x in self.parts.fresh])
            rows = {"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(a)), "a": a}
            self._put("given", pa.table(rows))
            body = self.db.sql(DECODE).to_arrow_table()["body"].combine_chunks().cast(pa.large_binary())
            _, offsets, flat = body.buffers()
            offsets = np.frombuffer(offsets, np.int64)[body.offset : body.offset + len(body) + 1]
            self.parts.add(np.frombuffer(flat, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets))
        flat, size = self.parts.take(numbers)
        before = np.concatenate([[0], np.cumsum(size)])
        parts = np.searchsorted(found, ends) - np.searchsorted(found, ends - counts)
        last = np.cumsum(parts)
        return flat, before[last] - before[last - parts]


@lru_cache(1)
def _codec(path: str) -> Codec:
    return Codec(path)


def _cuts(text: str) -> list[str]:
    """A long text's parts of about ``PIECE`` characters, cut where white space begins, as a word always does there."""
    parts, at = [], 0
    gap = regex.compile(r"(?<=\S)\s")
    while len(text) - at > PIECE:
        found = gap.search(text, at + PIECE)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def _text(value) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.binary())


def _encode(path, back: bool):
    def run(batches):
        codec = _codec(path())
        for batch in batches:
            column, rest = batch.column(0).cast(pa.binary()), batch.columns[1:]
            held, size, done = [], 0, 0  # parts with their rows
            pieces: dict[int, list[np.ndarray]] = {}

            def flush():
                ids, counts = codec.encode([t for _, t in held])
                for (row, _), own in zip(held, np.split(ids, np.cumsum(counts)[:-1])):
                    pieces.setdefault(row, []).append(own)

            for row in range(batch.num_rows + 1):
                last = row == batch.num_rows
                for part in [] if last else _cuts(_text(column[row].as_py())):
                    held.append((row, part))
                    size += len(part)
                    if size > PIECE:
                        flush()
                        held, size = [], 0
                if (last and held) or (row > done and not held):
                    if held:
                        flush()
                        held, size = [], 0
                    ends = row if last else row + 1
                    lists = [np.concatenate(pieces.pop(r)) for r in range(done, ends)]
                    counts, flat = np.array([len(x) for x in lists], np.int64), np.concatenate(lists)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                    if back:
                        made.append(_binary(*codec.decode(flat, counts)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(done, ends - done) for c in rest), *made], [*batch.schema.names[1:], "ids", "body"][: len(rest) + len(made)])
                    done = ends

    return run


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", path=public_path, bytes_col: str | None = None) -> DataFrame:
    """The columns of ``keep`` and ``ids_col``, an array of each whole text's ids; with ``bytes_col`` also what ``decode`` makes of them.

    A null or empty text has no ids. Bytes that are no UTF-8 count as U+FFFD. Rows, repeated ones and those of null keys
    too, stay as they are, and other columns are not looked at. Column names must differ.
    """
    made = [c for c in (ids_col, bytes_col) if c is not None]
    if len({*keep, *made}) < len(keep) + len(made):
        raise ValueError("two columns of one name")
    rows = docs.select(docs[text_col].cast("binary").alias("body"), *[docs[c].alias(f"k{n}") for n, c in enumerate(keep)])
    kinds = [f"k{n} {rows.schema[f'k{n}'].dataType.simpleString()}" for n in range(len(keep))]
    out = rows.mapInArrow(_encode(path, bytes_col is not None), ", ".join([*kinds, *["ids array<int>", "body binary"][: len(made)]]))
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], *[F.col(n).alias(c) for n, c in zip(("ids", "body"), made)])


def _decode(path):
    def run(batches):
        codec = _codec(path())
        for batch in batches:
            lists = batch.column(0)
            step = max(1, int(batch.num_rows * PIECE / max(1, len(lists.flatten()))))
            for a in range(0, batch.num_rows, step):
                part = lists.slice(a, step)
                counts = part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                bodies = _binary(*codec.decode(part.flatten().to_numpy(zero_copy_only=False), counts))
                bodies = pa.compute.if_else(part.is_valid(), bodies, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, step) for c in batch.columns[1:]), bodies], [*batch.schema.names[1:], "body"])

    return run


def decode(rows: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), bytes_col: str = "decoded", path=public_path) -> DataFrame:
    """The columns of ``keep`` and ``bytes_col``, the bytes that the ids spell (binary, as ids may end within a character).

    Null ids give null, no ids empty bytes; a null among ids or an id outside the vocabulary fails with a ValueError, as no bytes are right.
    """
    if bytes_col in keep:
        raise ValueError("two columns of one name")
    given = rows.select(rows[ids_col].alias("given"), *[rows[c].alias(f"k{n}") for n, c in enumerate(keep)])
    kinds = [f"k{n} {given.schema[f'k{n}'].dataType.simpleString()}" for n in range(len(keep))]
    out = given.mapInArrow(_decode(path), ", ".join([*kinds, "body binary"]))
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], F.col("body").alias(bytes_col))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path=public_path) -> DataFrame:
    """Each text's ``id_col``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by a space) and ``decoded_sha256`` (of the decoded bytes).

    Null and empty texts, repeated rows and null ids: see ``encode``.
    """
    rows = encode(docs, text_col, (id_col,), "_ids", path, "_body")
    return rows.select(
        id_col,
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("_body"), 256).alias("decoded_sha256"),
    )
