import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from fathomline.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def own(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}


def rebuilt(rows):
    turns = own(rows)
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + x[h:]
    return out


def plain(convs):
    nodes = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(nodes, key=len, reverse=True):
        if not children[k]:
            leaves[k] = 1
        saved[k] += (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        if k:
            children[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(k))))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), up, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def same(spark, rows, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that conversations cross parts
    try:
        got = pt.rebuilt_trie(frame(spark, rows).repartition(3))
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rebuilt(rows))
        got = pt.conversation_trie(frame(spark, rows))
        assert sorted(map(tuple, got.collect()), key=repr) == plain(own(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_beginnings(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no  go", "a b c", "é\tü"])) for c in range(-45, 130) if c % 7 for t in range(rng.randint(1, 6))]
    same(spark, rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "u", None), (1, 0, "u", None), (1, 0, "a", "x"), (2, 3, "u", " \t "), (None, 1, "u", "gone"), (21, 0, "u", "only"), (22, 5, None, "b"), (41, 0, "u", "only"), (20, 1, "s", "top"), (20, 0, "s", "first")]
    assert any(not x for x in rebuilt(rows).values())
    same(spark, rows)


def test_long_conversation_crosses_parts(spark):
    rows = [(5, t, "user", f"line {t % 3}") for t in range(700)] + [(6, t, "user", f"line {t % 3}") for t in range(300)] + [(7, t, "user", f"line {t % 4}") for t in range(40)] + [(c, 0, "user", "hello there") for c in range(100, 200)]
    same(spark, rows, 7)


def test_common_end_is_hashed_in_chunks(spark, monkeypatch):
    rows = [(c, t, "user", f"same {t}") for c in range(150) for t in range(2)]
    monkeypatch.setattr(pt, "CHUNK", 7)
    same(spark, rows)


def test_empty_table_and_clashing_names(spark):
    df = frame(spark, [(1, 0, "u", "x")])
    assert pt.rebuilt_trie(df.limit(0)).collect() == []
    other = df.selectExpr("conv_id", "turn as place", "role as part", "text as digest", "1 as h1", "2 as length", "3 as turn")
    got = pt.conversation_trie(other, turn_col="place", role_col="part", text_col="digest")
    assert len(got.collect()) == 2 and got.columns == COLUMNS


def test_shared_hashes_fail(spark, monkeypatch):
    """A collision of hashes stops the run."""
    monkeypatch.setattr(pt, "P61", 2)
    monkeypatch.setattr(pt.secrets, "randbelow", lambda n: 0)
    with pytest.raises(ArithmeticError):
        pt.conversation_trie(frame(spark, [(1, 0, "u", "x"), (2, 0, "u", "y")]))
