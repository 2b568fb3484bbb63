import hashlib
from collections import defaultdict

import numpy as np
import pytest

from fathomline.llm import suffix_dedup as sd
from fathomline.llm.collection import Collection


def brute(docs, span):
    seen = defaultdict(list)
    texts = [(i, (t or "").encode()) for i, t in docs]
    for n, (_, b) in enumerate(texts):
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]].append((n, k))
    gone = [np.zeros(len(b), bool) for _, b in texts]
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                gone[n][k : k + span] = True
    out = []
    for (i, b), g in zip(texts, gone):
        left = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows(sd.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], sd.SPAN)


def test_edges(spark):
    p = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    docs = [
        (1, p), (2, p), (3, None), (4, ""), (5, "x" * 700), (6, "ab" * 400 + p[:250]), (7, p[100:400] + "é" * 300), (None, "q" + p[3:290]),
        (8, "short"), (8, "short"), (9, p[200:399]), (10, "é" * 130), (11, "z" + p[250:450] + "y" + p[250:450]),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, gone string")
    want = brute(docs, sd.SPAN)
    assert rows(sd.remove_repeats(df)) == want
    assert rows(sd.remove_repeats(df, crowd=0)) == want
    assert rows(sd.remove_repeats(df, chunk=16)) == want
    assert rows(sd.remove_repeats(df.union(df))) == brute(docs + docs, sd.SPAN)
    assert rows(sd.remove_repeats(df.limit(0))) == []
    kept = {r.doc_id: r.kept_text for r in sd.remove_repeats(df, keep=["gone"]).collect()}
    assert kept[8] == "short" and kept[1] == ""


def test_collection_against_sorted_suffixes(tmp_path):
    rng = np.random.default_rng(3)
    grid = rng.integers(1, 4, (120, 14)).astype(np.int32)
    first, last = rng.integers(0, 6, 120), rng.integers(5, 14, 120)
    for chunk in (7, 64, 1 << 20):
        build = Collection(grid, first, last, chunk, f"file://{tmp_path}/tapes")
        before, common, doc, depth = (np.concatenate(x) for x in zip(*build.blocks()))
        suffixes = [tuple(grid[d, last[d] - k + 1 : last[d] + 1]) for d, k in zip(doc, depth)]
        assert len(suffixes) == (last - first + 2).sum() and suffixes == sorted(suffixes)
        assert before.tolist() == [grid[d, last[d] - k] if last[d] - k >= first[d] else 0 for d, k in zip(doc, depth)]
        for n in range(1, len(suffixes)):
            a, b = suffixes[n - 1], suffixes[n]
            assert common[n] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        build.close()
        assert not list(tmp_path.rglob("*")) or not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_a_crowded_anchor_is_dealt_again(spark):
    """A passage of 60 to 198 bytes in unlike texts: its anchor gathers them all, and only true repeats go."""
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 198, dtype=np.uint8)).decode()

    def noise(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()

    tails = [noise(150) for _ in range(5)]
    docs = [(i, noise(120) + passage[: 60 + 20 * (i % 7)] + (tails[i % 5] if i % 3 == 0 else noise(150))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, sd.SPAN)
    assert rows(sd.remove_repeats(df, crowd=100)) == want
    assert sum(n for _, _, n, _, _ in want) > 0


def test_an_anchor_of_more_segments_than_a_collection_takes(tmp_path):
    """More different segments of one anchor than CROWD in one collection, most of it in files."""
    rng = np.random.default_rng(6)
    n, anchor = sd.CROWD + 19_000, np.frombuffer(bytes(range(97, 137)), np.uint8)
    noise = rng.integers(97, 123, (n, 180), dtype=np.uint8)
    table = np.concatenate([noise[:, :20], np.tile(anchor, (n, 1)), noise[:, 20:]], axis=1)
    table[5] = table[70_000]
    table[5, :20] = 65
    table[5, 219] = 66
    place = f"file://{tmp_path}/tapes"

    def found():
        return np.argwhere(sd.repeated_windows(table.ravel(), np.arange(n + 1) * 220, np.full(n, 20), np.full(n, 21), np.ones(n, np.int64), place=place)).tolist()

    assert found() == []
    table[5, 219] = table[70_000, 219]
    assert found() == [[5, 20], [70_000, 20]]


#: A text and differences of at most three a byte that a polynomial modulo 2^64 in the anchors' base can't see.
MEET = (
    "iptsshkhnsnnqmsjhngtmmpssgrnkrsjphlgggqogmqjmrgojsnnojljqjsnkgmtoqhiqrtkhrlrromotqjkkpntomptgnjrsmmqilorsqrlhnqohsiotmlnrgngkrtpppmqiiojgsjotojmoltplnkqoprgmsttrosiosojmgntlpojomntlmlgoopsplnpgsjqiopi",
    [1, -3, -2, 0, -3, -3, 2, 3, -2, 0, 1, -1, 0, 0, 0, -3, 2, -1, 0, -1, 0, 2, 0, 1, 0, -2, -1, 1, 0, 1],
)


def test_texts_made_to_meet_are_kept(spark):
    text, steps = MEET
    other = "".join(chr(ord(c) + d) for c, d in zip(text, steps)) + text[len(steps) :]
    polynomial = lambda t: sum((ord(c) + 1) * pow(sd.BASE, i, 1 << 64) for i, c in enumerate(t)) % (1 << 64)
    assert len(text) == sd.SPAN and other != text and polynomial(text) == polynomial(other)
    docs = [(1, text), (2, other), (3, "q" + text[:150]), (4, other[:199])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for crowd in (sd.CROWD, 0):
        assert [r[2] for r in rows(sd.remove_repeats(df, crowd=crowd))] == [0] * 4
        twice = sd.remove_repeats(df.union(spark.createDataFrame([(5, "x" + other + "y")], df.schema)), crowd=crowd)
        assert {r[0]: r[2] for r in rows(twice)} == {1: 0, 2: 200, 3: 0, 4: 0, 5: 200}


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, n_bytes long")
    with pytest.raises(ValueError):
        sd.remove_repeats(df, keep=["n_bytes"])
    assert sd.remove_repeats(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
