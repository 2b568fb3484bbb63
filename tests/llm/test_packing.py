import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from fathomline.llm import packing


def encode(text):
    import public_tokenizers as files

    lib = encode.lib = getattr(encode, "lib", None) or Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    return [*lib.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs):
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array(encode(text), "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padded = 0
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        total += at
        padded += at if at & (at - 1) == 0 else packing.CAPACITY
    return total / max(padded, 1)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(3)).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) > 0.99


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 9000), (5, "é" * 300), (None, "x"), (7, " \n\n  y ")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, k int")
    check(packing.pack(df).collect(), docs)
    twice = packing.pack(df.union(df)).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(encode(t)) for _, t in docs)
    assert packing.pack(df.limit(0)).count() == 0
    with_ids = packing.pack(df, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)


def test_many_tasks_meet_in_rounds(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = packing.pack(docs.repartition(5)).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) > 0.99


def test_cuts():
    for n in (1, 2, 31, 1023, 1500, 2047, 2048, 2049, 100_001):
        cuts = packing.cut_lengths(n)
        assert sum(size for _, size in cuts) == n
        assert all(k * size <= packing.CAPACITY for k, size in cuts)


def test_long_runs(spark):
    """Runs that overflow a recursive pattern: the ids are the library's own."""
    n = 2_000_000
    docs = [(i, a + c * n + b) for i, (c, a, b) in enumerate([(" ", "", ""), (" ", "a", "b"), ("\n", "", "b"), ("\t", "a", ""), ("\r", "a", "!b"), ("\u2003", "", " x"), ("a", "", "")])]
    docs.append((99, " " * 60_000 + "it's" + "\n" * 70_000 + " so" + " " * 50_000 + "<|endoftext|>" + " " * 55_000 + "."))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    check(packing.pack(df).collect(), docs)
    coder = packing.public_encoder()
    for text in ("\x1c" * 60_000 + "a", " " * 49_999 + "a", " " * 50_000 + "a", "\x85" * 50_001 + "é"):
        assert coder.encode(text) == np.array(encode(text)[:-1], "<u4").tobytes()
