import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from fathomline.llm import fingerprint as fp


def canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t).strip()


def check(rows, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    got = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    want, prints = [], {}
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        same = [j for j, u in docs if canon(u) == canon(t) and j is not None]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(after) == canon(t)), min(same, default=None)))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.class_id) for r in got] == want
    by_id = {}
    for i, t in docs:
        by_id.setdefault(canon(t), set()).update(r.fingerprint for r in got if r.doc_id == i and sum(d[0] == i for d in docs) == 1)
    prints = [p for p in by_id.values() if p]
    assert all(len(p) == 1 for p in prints) and len(set.union(*prints)) == len(prints)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(fp.fingerprint_edits(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


DOCS = [(3, "Straße  X"), (1, "STRASSE x\n"), (7, None), (9, ""), (2, "ﬁne É"), (4, "fine é"), (None, "lone"), (12, "abcdefgh" * 500), (11, "　a b "), (10, "A B"), (10, "A B")]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in DOCS], "doc_id long, text string, body string")
    check(fp.fingerprint_edits(df).collect(), DOCS)
    assert fp.fingerprint_edits(df.limit(0)).count() == 0
    check(fp.fingerprint_edits(df.where("doc_id = 4")).collect(), [d for d in DOCS if d[0] == 4])


def test_collisions_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.id): r.class_id for r in fp.exact_classes(df, hasher=lambda c: F.concat(F.lit("0"), F.lit(""), F.substring(c, 1, 0))).collect()}
    for i, t in DOCS:
        if i is not None:
            assert got[i] == min(j for j, u in DOCS if j is not None and canon(u or "") == canon(t or ""))


def test_no_python_in_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = fp.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
