import base64
import hashlib
import io
from collections import Counter

import pytest

from fathomline.llm import warc


def brute(rows):
    best = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if p not in best or (i is not None and (best[p] is None or i > best[p])):
            best[p] = i
    out, used = Counter(), set()
    for i, _, html in sorted(rows, key=str):
        p = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        if i == best[p] and p not in used:
            used.add(p)
            out[i, len(p), d, "response", None] += 1
        else:
            out[i, len(p), d, "revisit", best[p]] += 1
    return out


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(warc.archive_pages(pages)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_edges(spark):
    rows = [(1, "u", "<p>é</p>"), (2, "v\r\nX: y", "<p>é</p>"), (3, None, None), (4, "w", ""), (5, "x", "z" * 3_000_000), (None, "n", "alone"), (7, "a", "b"), (7, "a", "b"), (6, "q", "b"), (8, "r", "a\r\n\r\nb")]
    df = spark.createDataFrame([(i, u, h, "k") for i, u, h in rows], "page_id long, url string, html string, digest string")
    assert got(warc.archive_pages(df)) == brute(rows)
    assert warc.archive_pages(df.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in warc.archive_pages(df, min_bytes=100).collect()}
    assert set(small.values()) == {"response"}


def test_round_trip_and_rolling(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = warc.write_archives(pages, archive_bytes=50_000)
    assert archives.count() > 1
    back = {int(r.page): bytes(r.payload) for r in warc.read_archives(archives).where("payload is not null").collect()}
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    assert all(html[i] == p for i, p in back.items()) and {*back.values()} == {*html.values()}


def test_dictionary_frame_and_damage():
    data = [warc.record(i, "u", b"<html>" + bytes([97 + i % 26]) * 300, "D") for i in range(40)]
    d = warc.build_dictionary(data)
    import zstandard

    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    whole = warc.head_frame(d) + b"".join(c.compress(x) for x in data)
    assert [x for _, x in warc.read_records(io.BytesIO(whole))] == data
    for at, x in list(warc.read_records(io.BytesIO(whole)))[:3]:
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompressobj().decompress(whole[at:]) == x
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole[:-3])))


def test_against_sql(spark, sf_dir):
    import duckdb

    from fathomline.llm import queries

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_warc"])
    got = queries.op10_warc(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall(), key=lambda r: r)
