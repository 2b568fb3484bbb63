import random

import sentencepiece

from fathomline.llm import pieces


def library():
    """The public vocabulary as the library's own unigram model: the kind of model is set last, so it counts."""
    with open(pieces.public_path(), "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")


TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "naïve façade – 你好 😀", "x\ty\nz", "▁mark", "1234567 8,9.0", "aaaaaaa bbbbb"]


def test_like_the_library_lattice(spark, sf_dir):
    own, lib = pieces.Vocabulary(pieces.public_path()), library()
    words = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() for w in r.text.split(" ")]
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(300)]
    for t in texts:
        ids, score = own.encode(t)
        if t.strip() and not any(own.kinds[i] == pieces.BYTE for i in ids) and "  " not in t:
            best = lib.nbest_encode_as_ids(t, 2)[0]  # the lattice's best path
            assert abs(score - sum(own.scores[i] for i in best)) < 1e-6 * abs(score), t
        assert lib.decode(ids.tolist()) == own.decode(ids.tolist()) == t.replace(pieces.MARK, " "), t


def brute(v, text):
    scores = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == pieces.NORMAL}
    best = [0.0]
    for end in range(1, len(text) + 1):
        best.append(max([best[s] + scores[text[s:end]] for s in range(max(0, end - 64), end) if text[s:end] in scores] + ([best[end - 1] + v.least] if text[end - 1] not in scores else [])))
    return best[-1]


def test_best_score(spark, sf_dir):
    v = pieces.Vocabulary(pieces.public_path())
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(10).collect():
        text = r.text[:1500]
        assert abs(v.encode(text)[1] - brute(v, v.normalise(text))) < 1e-6
        assert v.viterbi(v.normalise(text))[0] == v.encode(text)[0].tolist()


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "word " * 20000), (None, "é"), (5, "same"), (5, "same"), (6, "\U0001f600" * 50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    out = pieces.encode(df, keep_ids=True)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    back = pieces.decode(out).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert pieces.encode(df.limit(0)).count() == 0
