"""WARC archives of individually Zstandard-compressed records that share a dictionary.

An archive begins with a skippable frame that holds the dictionary; each record is a
frame of its own after it, so any record can be read from its offset. The dictionary is built from
a bounded sample of records. Records of equal payload are archived once; the others are
revisit records that refer to it.

Executors write archives to the shared folder under names of their own attempt, and a table lists the
archives of the attempts that counted; what a lost executor left is not in the table.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import settle, shared_dir

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
FRAME = 0xFD2FB528  # fixed value: begin of a Zstandard frame
LEVEL = 6
ARCHIVE_BYTES = 64 << 20  # an archive ends after so many bytes
#: Bounds of the dictionary and of the records it is built from.
DICT_BYTES = 64 << 10
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 8 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPE = "application/http; msgtype=response"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, original: bool = True) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    block = HEAD % len(payload) + (payload if original else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original else 'revisit'}",
        f"WARC-Record-ID: <{record_urn(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if not original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    lines += [f"Content-Type: {TYPE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its head says")
    return fields, rest[:size]


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; raw content where they are too few to train on."""
    total = sum(map(len, samples))
    if len(samples) >= 8 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def head_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def read_records(stream):
    """``(offset, record bytes)`` of an archive, one record in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    packed = stream.read(size)
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == struct.pack("<I", FRAME) else packed
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, held = 8 + size, b""
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        frame, out, used = codec.decompressobj(), io.BytesIO(), 0
        while True:
            out.write(frame.decompress(held))
            used += len(held)
            if frame.eof:
                held = frame.unused_data
                used -= len(held)
                break
            held = stream.read(1 << 20)
            if not held:
                raise ValueError("an archive ends within a record")
        yield at, out.getvalue()
        at += used


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(place: str, dictionary: bytes, limit: int):
    def run(batches):
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        task = TaskContext.get()
        stem = f"{place}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, _ = _open(place)
        done, out, size, count = [], None, 0, 0

        def end():
            nonlocal out
            out.close()
            done.append((uri, count, size))
            out = None

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(6)]):
                page, url, html, digest, head, original = row
                if out is None:
                    uri = f"{stem}-{len(done)}.warc.zst"
                    out, count = fs.open_output_stream(_open(uri)[1]), 0
                    size = out.write(head_frame(dictionary))
                payload = (html.as_py() or "").encode()
                data = record(page.as_py(), url.as_py(), payload, digest.as_py(), head.as_py(), original.as_py())
                size += out.write(codec.compress(data))
                count += 1
                if size >= limit:
                    end()
        if out is not None:
            end()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[n] for d in done], t) for n, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"]
        )

    return run


def _hashes():
    def run(batches):
        for batch in batches:
            digest, size = [], []
            for html in batch.column(1):
                payload = (html.as_py() or "").encode()
                digest.append(payload_digest(payload))
                size.append(len(payload))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.string()), pa.array(size, pa.int64()), batch.column(2)], ["page_id", "digest", "size", "mark"]
            )

    return run


def _read():
    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = _open(archive)
                rows = []

                def out():
                    cols = list(zip(*rows))
                    rows.clear()
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], FIELDS)

                held = 0
                with fs.open_input_stream(path) as stream:
                    for at, data in read_records(stream):
                        fields, block = parse(data)
                        http, _, body = block.partition(b"\r\n\r\n")
                        original = fields["WARC-Type"] == "response"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        if original and (payload_digest(body) != digest or len(body) != size):
                            raise ValueError(f"{archive} at {at}: the payload differs from its digest")
                        rows.append((archive, at, fields["X-Page-ID"], fields["WARC-Target-URI"], fields["WARC-Type"], digest, size, fields.get("X-Refers-To-Page"), body if original else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield out()
                            held = 0
                if rows:
                    yield out()

    return run


FIELDS = ["archive", "at", "page", "url", "record_type", "payload_digest", "payload_bytes", "refers", "payload"]


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    place: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Archive each row; returns the table of archives (``archive``, ``records``, ``bytes``).

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one of the largest id (of several
    such, any one) is a response and the others revisit it; shorter ones are responses.
    """
    spark = pages.sparkSession
    place = place or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, path = _open(place)
    fs.create_dir(path, recursive=True)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("mark", F.xxhash64("page_id", "url", "html"))
    light = rows.select("page_id", "html", "mark").mapInArrow(_hashes(), f"page_id {kind}, digest string, size long, mark long")
    light = settle(light, "digests")
    best = F.max(F.struct("page_id", "mark")).alias("best")  # one row for each digest; partial maxima before the exchange
    heads = light.where(F.col("size") >= min_bytes).groupBy("digest").agg(best)
    # equal rows can't be told apart by id and mark: count them, and of the best ones the first written is the response
    named = light.distinct().join(heads, "digest", "left").select(
        F.col("page_id").alias("own"), F.col("mark").alias("own_mark"), "digest", F.col("best.page_id").alias("head"),
        (F.col("best").isNull() | (F.struct("page_id", "mark").eqNullSafe(F.col("best")))).alias("original"), F.col("best").isNotNull().alias("grouped"),
    )
    full = rows.join(named, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")))
    fields = ["page_id", "url", "html", "digest", "head", "original"]
    repeats = light.groupBy("page_id", "mark").count().where("count > 1").select(F.col("page_id").alias("r_id"), F.col("mark").alias("r_mark"), F.lit(True).alias("again"))
    once = full.select(*fields)
    if not repeats.isEmpty():
        full = full.join(repeats, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left")
        twin = F.col("again").isNotNull() & F.col("original") & F.col("grouped")
        many = full.where(twin).groupBy("page_id", "url", "html", "digest", "head").count()
        many = many.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).withColumn("original", F.col("turn") == 1)
        once = full.where(~twin).select(*fields).unionByName(many.select(*fields))
    step = max(1, light.count() // SAMPLE_RECORDS)
    sample = rows.where(F.pmod("mark", F.lit(step)) == 0).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"), "mark")
    sample = sorted(sample.limit(2 * SAMPLE_RECORDS).collect(), key=lambda r: r.mark)
    samples = [record(r.page_id, r.url, p := (r.html or "").encode(), payload_digest(p)) for r in sample]
    dictionary = build_dictionary(samples)
    archives = once.mapInArrow(_write(place, dictionary, archive_bytes), "archive string, records long, bytes long")
    return settle(archives, "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the listed archives; a response's payload is checked against its digest."""
    fields = "archive string, at long, page string, url string, record_type string, payload_digest string, payload_bytes long, refers string, payload binary"
    files = archives.select("archive").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive")
    return files.mapInArrow(_read(), fields)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all rows to archives, read these back and describe each record.

    Returns ``id_col``, ``payload_bytes``, ``payload_digest`` (bare upper-case base32 SHA-1 of the full
    payload), ``record_type`` and ``refers_to`` (a revisit's response, else null). A null html is
    empty; a null url is empty; a null id is the smallest; a repeated row is archived as often as it comes, one of
    its equals as the response; long pages are archived whole; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    back = read_archives(write_archives(pages, id_col, url_col, html_col, min_bytes))

    def number(c: str):
        return F.when(F.col(c) == "", None).otherwise(F.col(c)).cast(kind)

    return back.select(number("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))
