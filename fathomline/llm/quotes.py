"""Quotation linking: conversations in reply order, without the text that messages quote.

A line's quote level is the number of ``>`` it begins with. A quoted block is a run of quoted
lines of one level; an attribution line before it ("... wrote:") belongs to it. Blocks and the
messages' own words are cut to units (the whole, paragraphs, sentences, lines), normalised and hashed to 128 bits. Sentences
go over line ends, so a passage that was wrapped anew still has units in common; part of a sentence that is no line has none.

A block is linked by its largest unit that an original holds: to the latest earlier turn of its own
conversation, else to the first other conversation's message that has it. Per unit, one
running value over the conversation's turns and one minimum over all messages are enough, so a
common line costs its rows and not their product. A message replies to the latest turn that
its outermost quotes link to; threads are found by pointer doubling.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import settle

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"\b(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$", re.IGNORECASE)
BLANK = re.compile(r"\n[ \t]*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted blocks as ``(level, text)`` in order."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    inside = 0
    for line in text.split("\n"):
        found = QUOTED.match(line)
        level = found[1].count(">") if found else 0
        if not level:
            own.append(line)
        else:
            if level != inside:
                if not inside:
                    while own and not own[-1].strip():
                        own.pop()
                    if own and ATTRIBUTION.search(own[-1]):
                        own.pop()
                blocks.append((level, []))
            blocks[-1][1].append(line[found.end() :])
        inside = level
    body = "\n".join(own) if blocks else text
    return (re.sub(r"\n{3,}", "\n\n", body).strip() if blocks else body), [(k, "\n".join(b)) for k, b in blocks]


def normal(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.casefold()).split())


def units(text: str) -> list[list[str]]:
    """Normalised units of a text by rank: the whole, its paragraphs, its sentences, its lines."""
    parts = BLANK.split(text)
    found = [[text], parts, [s for p in parts for s in SENTENCE.split(p)], text.split("\n")]
    return [[u for u in map(normal, rank) if u] for rank in found]


def _hash(unit: str) -> tuple[int, int]:
    raw = unit.encode()
    return xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63)


UNIT = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
QUOTE = pa.struct([("block", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _parse():
    def run(batches):
        for batch in batches:
            bodies, own, quoted, counts = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                body, blocks = parse(text.as_py() or "")
                bodies.append(body)
                counts.append(len(blocks))
                own.append([dict(zip(("h1", "h2"), _hash(u))) for u in {u for rank in units(body) for u in rank}])
                quoted.append(
                    [
                        {"block": n, "level": level, "rank": rank, "h1": h[0], "h2": h[1]}
                        for n, (level, block) in enumerate(blocks)
                        for rank, found in enumerate(units(block))
                        for h in map(_hash, found)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bodies, pa.string()), pa.array(counts, pa.int32()), pa.array(own, pa.list_(UNIT)), pa.array(quoted, pa.list_(QUOTE))],
                [*batch.schema.names[:-1], "body", "n_quotes", "own", "quoted"],
            )

    return run


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Messages without their quotes, with what they reply to.

    Returns ``conv_id``, ``turn``, ``role``, ``text`` (own words), ``n_quotes`` (quoted blocks), ``n_linked`` (those with an
    original), ``parent_turn`` (null for no reply within the conversation), ``thread_turn`` (its thread's first
    turn), ``depth`` (replies up to there) and ``source_conv`` (first other conversation that it quotes, else null).
    By (``conv_id``, ``thread_turn``, ``turn``) every message follows the one it replies to. Null text is empty;
    a row with a null conversation or turn takes no part in linking and is its own thread; equal (conversation,
    turn) rows are linked alike; an empty table gives an empty result; other columns are not looked at.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role {kinds['role']}, body string, n_quotes int, own array<struct<h1: long, h2: long>>, quoted array<struct<block: int, level: int, rank: int, h1: long, h2: long>>"
    parsed = settle(rows.mapInArrow(_parse(), schema), "messages")
    known = parsed.where("conv is not null and turn is not null")
    quotes = known.where("n_quotes > 0").select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*").distinct()
    quotes = settle(quotes, "quotes")
    if quotes.isEmpty():
        flat = parsed.select("conv", "turn", "role", F.col("body").alias("text"), "n_quotes", F.lit(0).cast("long").alias("n_linked"),
                             F.lit(None).cast(kinds["turn"]).alias("parent_turn"), F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kinds["conv"]).alias("source_conv"))
        return flat.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    asked = quotes.select("h1", "h2").distinct()
    held = known.select("conv", "turn", F.explode("own").alias("u")).select("conv", "turn", "u.h1", "u.h2").join(asked, ["h1", "h2"], "left_semi")
    held = settle(held, "originals")
    # latest earlier turn in the conversation: turns that hold the unit and turns that quote it, in one running maximum
    marks = held.select("conv", "turn", "h1", "h2", F.col("turn").alias("holds"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("rank"))
    marks = marks.unionByName(quotes.select("conv", "turn", "h1", "h2", F.lit(None).cast(kinds["turn"]).alias("holds"), "block", "level", "rank"))
    before = Window.partitionBy("conv", "h1", "h2").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = marks.withColumn("from_turn", F.max("holds").over(before)).where("block is not null").drop("holds")
    # else the first holder in another conversation: the two smallest conversations of a unit are enough
    firsts = held.groupBy("h1", "h2").agg(F.min("conv").alias("first"))
    second = held.join(firsts, ["h1", "h2"]).where("conv <> first").groupBy("h1", "h2").agg(F.min("conv").alias("second"))
    far = firsts.join(second, ["h1", "h2"], "left")
    linked = near.join(far, ["h1", "h2"], "left").withColumn("other", F.when(F.col("first") != F.col("conv"), F.col("first")).otherwise(F.col("second")))
    linked = linked.where("from_turn is not null or other is not null")
    choice = F.struct(F.col("from_turn").isNull().cast("int"), "rank", -F.coalesce("from_turn", F.lit(0)), "other")
    best = linked.groupBy("conv", "turn", "block", "level").agg(F.min_by(F.struct("from_turn", "other"), choice).alias("to"))
    best = best.select("conv", "turn", "block", "level", "to.*")
    outer = F.min(F.when(F.col("from_turn").isNotNull(), F.col("level")))
    level = best.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), outer.alias("outer"), F.min(F.when(F.col("from_turn").isNull(), F.col("other"))).alias("source_conv"))
    parent = best.join(level.select("conv", "turn", "outer"), ["conv", "turn"]).where("level = outer").groupBy("conv", "turn").agg(F.max("from_turn").alias("parent_turn"))
    level = settle(level.drop("outer").join(parent, ["conv", "turn"], "left"), "replies")
    # pointer doubling from each reply to its thread's first turn
    jump = settle(level.where("parent_turn is not null").select("conv", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        ahead = jump.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        step = jump.join(ahead, ["conv", "top"], "left")
        step = settle(step.select("conv", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if step.where("moved").isEmpty():
            break
        jump = step.drop("moved")
    facts = level.join(jump.drop("moved"), ["conv", "turn"], "left")
    facts = facts.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "n_linked", "parent_turn", "top", "depth", "source_conv")
    out = parsed.join(facts, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    out = out.select("conv", "turn", "role", F.col("body").alias("text"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn",
                     F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "source_conv")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
