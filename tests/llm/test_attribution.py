import numpy as np
import pytest
from tokenizers import Tokenizer

from fathomline.llm import attribution as at


def brute(text, rule):
    import public_tokenizers as files

    lib = brute.lib = getattr(brute, "lib", None) or Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    lines = text.splitlines(keepends=True) if set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") == set() else None
    lines = lines if lines is not None else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    lines = lines or [""]
    owner = [n for n, line in enumerate(lines) for _ in line]
    tokens, crossing = [0] * len(lines), [0] * len(lines)
    for a, b in lib.encode(text, add_special_tokens=False).offsets:
        own = owner[a:b]
        n = own[0] if rule == "first" else max(sorted(set(own)), key=own.count)
        tokens[n] += 1
        crossing[n] += len(set(own)) > 1
    return list(zip(range(len(lines)), tokens, crossing))


TEXTS = ["", "a", "one\ntwo", "\n\n\nx\n\n", "é\n\n\n 你好 😀😀\n", "tail\n", " \n \n\n  y", "x <|endoftext|> y\nz", "end\n\n\n\n\n\nword"]


@pytest.mark.parametrize("rule", at.RULES)
def test_against_library_offsets(spark, sf_dir, rule):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(1000 + n, t) for n, t in enumerate(TEXTS)]
    both = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in at.section_tokens(both, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing))
    for r in both.collect():
        assert sorted(got[r.doc_id]) == brute(r.text, rule), r.text


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a\nb", 2), (3, "x", 3), (3, "x", 3), (4, "w " * 30000, 4)], "doc_id long, text string, section int")
    rows = at.section_tokens(df).collect()
    assert len(rows) == 6 and sum(r.n_tokens for r in rows if r.doc_id == 1) == 0
    assert at.section_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        at.section_tokens(df, rule="last")


def test_long_runs(spark):
    rows = [(n, "a" + c * 1_500_000 + "b") for n, c in enumerate(" \n\tz")]
    got = at.section_tokens(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").sum("n_tokens", "n_crossing").collect()
    lib = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert {r[0]: r[1] for r in got} == {n: len(lib.encode(t, add_special_tokens=False).ids) for n, t in rows}


def test_token_over_many_sections():
    where, crosses = at.attribute(np.array([0, 5]), np.array([5, 6]), np.array([0, 1, 4, 5, 6]))
    assert where.tolist() == [1, 3] and crosses.tolist() == [True, False]
