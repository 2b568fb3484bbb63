
import pytest

import corpus_pipeline as cp
from fathomline.llm import language
from fathomline.llm.common import settle
from tests_llm_help import strip


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(settle(stage(spark, out[-1], "/root/testdata/sf0.001"), name))
    return out


def test_language_keeps_nearly_all_with_letters(stages):
    before = {r.doc_id: r.text for r in stages[0].collect()}
    after = {r.doc_id: r.text for r in stages[1].collect()}
    assert all(before[i] == t for i, t in after.items())
    gone = [i for i in before.keys() - after.keys() if language.LETTER.search(before[i] or "")]
    assert len(gone) <= 0.01 * len(before)
    assert stages[1].columns == cp.COLUMNS


def test_one_of_each_group_stays(stages):
    from test_near_copies import brute

    docs = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == set(brute(docs).values())


def test_repeats_go(stages):
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i: t for i, t in strip(docs).items() if t.strip() or t == dict(docs)[i]}
    assert {r.doc_id: r.text for r in stages[3].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_pieces_cover_what_is_left(stages):
    from test_packing import check

    assert check(stages[4].collect(), [(r.doc_id, r.text) for r in stages[3].collect()]) > 0.98


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
