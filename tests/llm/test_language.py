import zlib

import numpy as np
import pytest

from fathomline.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.fit(docs, windows=900)).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert len(got) == len(lang)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    judged = [r for r in out if r.lang_pred != "und"]
    assert len(judged) > 0.98 * len(out)
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in judged]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(0, "der die und das ist ein nicht " * 9, "de"), (2, "the and of to that is was " * 9, "en"), (4, None, "en"), (5, "", None),
            (6, "12 34 !?", "en"), (None, "the and of to", "de"), (8, "the and of that was " * 9000, None), (8, "und der", "en")]
    df = spark.createDataFrame([(i, t, lang, 1.5) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, n): r for n, r in enumerate(language.identify(df.coalesce(1), language.fit(df)).collect())}
    assert [got[k].lang_pred for k in got if k[1] in (2, 3, 4)] == ["und"] * 3
    assert all(r.lang_pred in ("de", "en", "und") for r in got.values())
    nothing = language.identify(df, language.fit(df.where("lang is null"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(df.limit(0), language.fit(df.limit(0))).count() == 0


def test_prediction_ignores_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, windows=200)
    a = language.identify(docs, model)
    b = language.identify(docs.selectExpr("doc_id", "text", "'zz' as lang"), model)
    assert a.exceptAll(b).isEmpty()


def windows(texts):
    return np.concatenate([language.windows_of(np.frombuffer(t.encode(), np.uint8)) for t in texts])


def test_training_separates_two_patterns():
    texts = ["abcabcabc " * 8, "xyzxyzxyz " * 8] * 40
    model = language.train(windows(texts), ["a", "b"] * 40)
    p = model.probabilities(windows(texts[:2]))
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9


def test_forward_pass_against_plain_loops():
    rng = np.random.default_rng(1)
    p = language._begin(rng, 3)
    model = language.Model(["a", "b", "c"], *(p[k] for k in ("embed", "filters", "bias", "dense", "offset")))
    x = windows(["The quick brown fox, été. ", "zz"])
    for window, got in zip(x, model.probabilities(x)):
        pooled = []
        for f in range(language.FILTERS * len(language.WIDTHS)):
            width = language.WIDTHS[f // language.FILTERS]
            best = max(
                sum(float(p["embed"][window[at + j], d]) * float(p["filters"][j * language.DIM + d, f]) for j in range(width) for d in range(language.DIM))
                for at in range(len(window) - max(language.WIDTHS) + 1)
            )
            pooled.append(max(0.0, best + float(p["bias"][f])))
        raw = np.array(pooled) @ p["dense"] + p["offset"]
        want = np.exp(raw - raw.max())
        assert np.allclose(got, want / want.sum(), atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in language._begin(rng, 2).items()}
    x, y, weight = windows(["some text here", "andere Worte"]), np.array([0, 1]), np.array([0.7, 1.3])
    _, g = language.loss_and_gradient(p, x, y, weight)
    for name in p:
        used = np.argwhere(np.abs(g[name]) > 1e-4)
        for at in map(tuple, used[rng.permutation(len(used))[:6]]):
            step = np.zeros_like(p[name])
            step[at] = 1e-6
            up, _ = language.loss_and_gradient(p | {name: p[name] + step}, x, y, weight)
            down, _ = language.loss_and_gradient(p | {name: p[name] - step}, x, y, weight)
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-4


def test_ties_and_clashing_columns(spark):
    flat = language.Model(["aa", "bb"], *(np.zeros(s, np.float32) for s in ((257, language.DIM), (max(language.WIDTHS) * language.DIM, 64), 64, (64, 2), 2)))
    df = spark.createDataFrame([(1, "some words", "x", 7, True)], "doc_id long, text string, lang_pred string, score int, held_out boolean")
    assert language.identify(df, flat).collect()[0].lang_pred == "aa"
    row = language.identify(df.withColumnsRenamed({"lang_pred": "old", "score": "points"}), flat, keep=["old", "points"]).collect()[0]
    assert (row.lang_pred, row.score, row.old, row.points) == ("aa", 0.5, "x", 7)
    with pytest.raises(ValueError):
        language.identify(df, flat, keep=["score"])


def test_sample_covers_all_windows_of_long_texts(spark):
    long = "".join(f"das ist Satz {k} von vielen. " for k in range(4000))
    df = spark.createDataFrame([(0, long, "de"), (1, "the and of that was " * 9000, "en")], "doc_id long, text string, lang string")
    model = language.fit(df, windows=300)
    got = language.identify(df.selectExpr("doc_id", "substring(text, 60000, 4000) as text"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {0: "de", 1: "en"}
