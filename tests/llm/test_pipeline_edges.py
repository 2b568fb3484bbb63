"""Each stage on null texts, empty tables, repeated ids and rows, very long texts and extra columns."""

import pytest

import corpus_pipeline as cp

WORDS = " ".join(f"the house number {k} stands near a river and has {k * k % 83} windows" for k in range(30))
ROWS = [
    (1, WORDS, "en", "a", 1),
    (1, "An entirely different text of the same id, long enough to be told apart.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, WORDS.replace("river", "lake"), "en", "b", 5),
    (None, WORDS.replace("river", "lake"), "en", "b", 5),
    (5, "short", None, "c", 5),
    (6, "long " * 150_000, "en", "c", 9),
    (7, " " * 1_500_000 + "a", "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def stage(name):
    return dict(cp.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows(spark, docs, name):
    out = stage(name)(spark, docs, "").collect()
    if name == "near_copies":
        assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in out) == [(0, "the"), (1, "An "), (1, "the"), (2, ""), (5, "sho"), (6, "lon"), (7, "   ")]
    elif name == "repeats":
        assert {(r.doc_id, r.text) for r in out} >= {(2, ""), (3, ""), (5, "short")}
    elif name == "packing":
        assert {r.doc_id for r in out} == {1, 2, 3, None, 5, 6, 7}
    else:
        assert not {r.doc_id for r in out} & {2, 3}


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_table_and_extra_columns(spark, docs, name):
    assert stage(name)(spark, docs.limit(0), "").count() == 0
    extra = docs.selectExpr("*", "1 as score", "2 as component_id", "3 as kept_text", "4 as low", "5 as t1").where("doc_id = 5")
    out = stage(name)(spark, extra, "")
    assert name == "packing" or out.columns == cp.COLUMNS
    out.collect()
