import base64
import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as files
from fathomline.llm import bpe


@pytest.fixture(scope="module")
def library():
    with open(bpe.public_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.public_path())


def ids_of(codec, texts):
    ids, n = codec.encode(texts)
    flat, size = codec.decode(ids, n)
    assert [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])] == [t.encode() for t in texts]
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aab'’sStremvld  \n\t\x1c é1٣.,!-　中文😀", max_size=30) | st.text(max_size=30), max_size=8))
def test_words_are_the_pattern_s(texts):
    whole, starts, counts = bpe.word_starts(texts)
    bounds = [*starts.tolist(), len(whole)]
    found = [regex.findall(files.PATTERN, t) for t in texts]
    assert [whole[i:j] for i, j in zip(bounds, bounds[1:])] == [w for ws in found for w in ws]
    assert counts.tolist() == list(map(len, found))


def test_long_words(codec, library):
    rng = random.Random(5)
    texts = ["a" * 999, "ab" * 700, "=" * 1234, " " * 777 + "x", "\n" * 500, "中文" * 300, "é" * 333, "-_" * 400, "".join(rng.choices("etaoin", k=900)), "'" * 300 + "s"]
    want = [library.encode_ordinary(t) for t in texts]
    assert ids_of(codec, texts) == want
    assert ids_of(bpe.Codec(bpe.public_path(), long=1 << 30), texts) == want  # pair by pair
    assert ids_of(bpe.Codec(bpe.public_path(), long=3, held=2000), texts) == want  # many queries


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    codec = bpe.Codec(bpe.public_path())
    rng = random.Random(7)
    for _ in range(6):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(40)) for _ in range(3)]
        assert ids_of(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch, library, codec):
    monkeypatch.setattr(bpe, "PIECE", 50)
    text = "It's  a   line\n\n of ' words 's " * 40 + "x" * 120
    parts = bpe._cuts(text)
    assert len(parts) > 10 and "".join(parts) == text
    assert sum(ids_of(codec, parts), []) == library.encode_ordinary(text)


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert tuple(got[doc_id])[1:] == want, doc_id


def test_edges(spark, library, monkeypatch):
    rows = [(1, None, "x"), (2, "", None), (None, "It's a 1st  test.\n\n", "y"), (None, "It's a 1st  test.\n\n", "y"), (5, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k0 string").withColumnsRenamed({"k0": "ids"})
    with pytest.raises(ValueError):
        bpe.encode(df, keep=("doc_id", "ids"))
    out = bpe.encode(df, keep=("doc_id", "ids", "text"), ids_col="own")
    assert out.columns == ["doc_id", "ids", "text", "own"]
    got = sorted((r["doc_id"] or 0, r["own"]) for r in out.collect())
    assert got == sorted((i or 0, library.encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.round_trip(df.limit(0)).collect() == []
    ids = spark.createDataFrame([(1, [])], "doc_id long, ids array<int>").unionByName(spark.createDataFrame([(2, None), (3, [72, 0])], "doc_id long, ids array<int>"))
    assert sorted(map(tuple, bpe.decode(ids, keep=("doc_id",)).collect())) == [(1, b""), (2, None), (3, b"i!")]
    with pytest.raises(ValueError):
        bpe.Codec(bpe.public_path()).decode(np.array([50256]), np.array([1]))
