"""Content-addressed WARC archive: payloads stored once, headers kept exactly."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bucketed, shared_dir, ship, stored
from . import joins

CRLF = "\r\n"
#: Equal payloads of fewer bytes are not turned into revisits.
SMALLEST = 100
_URN = "urn:uuid:"


class Archive(NamedTuple):
    """records: path of a table (record_no, digest, header); payloads: name of a
    table (digest, payload), bucketed by digest."""

    records: str
    payloads: str


def record_id(key: Column) -> Column:
    """A name-based record id, the same whenever the row is written again."""
    h = F.sha2(F.concat(F.lit("record:"), key.cast("string")), 256)
    return F.concat(F.lit("<" + _URN), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)), F.lit(">"))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", where: str | None = None) -> Archive:
    """Write a WARC record per row.

    Of rows with equal payloads of at least SMALLEST bytes, the one with the
    smallest id becomes a response and the others revisits that refer to it;
    smaller payloads are always responses. A null payload is empty, a null url
    has no target line, line breaks in urls become spaces. Rows of one id and
    payload are a response each if that id is the smallest. A null id comes
    after all others; if only null ids share a payload all are responses.

    Payloads are addressed by their SHA-256 and stored once, in a table
    bucketed by it; rows that share a digest but differ in length or in a second
    hash stop the write. Headers are stored as written. Hot payloads combine
    before the shuffle.
    """
    spark = pages.sparkSession
    where = where or f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    raw = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8") if pages.schema[payload_col].dataType.typeName() == "string" else F.coalesce(F.col(payload_col), F.lit(b""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), raw.alias("payload"))
    digest = F.sha2("payload", 256)
    name = "warc_payloads_" + uuid.uuid4().hex
    once = base.select(digest.alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload"), F.min(F.xxhash64("payload", F.length("payload"))).alias("h1"), F.max(F.xxhash64("payload", F.length("payload"))).alias("h2"))
    once = once.select("digest", F.when(F.col("h1") == F.col("h2"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest"))).cast("binary").alias("payload"))
    bucketed(once, "digest", "warc_payloads", where + "/payloads", sort=True, name=name)
    rows = base.select("id", "url", digest.alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    least = rows.where(F.col("n") >= SMALLEST).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1")
    rows = joins.join_groups(rows, stored(least, "least"), ["digest"], "c", "left")
    again = F.coalesce((F.col("n") >= SMALLEST) & (F.col("id").isNull() | (F.col("id") > F.col("least"))) & F.col("least").isNotNull(), F.lit(False))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.coalesce(F.col("id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _one_line(F.col("url")))).otherwise(F.lit("")),
        F.when(F.col("id").isNotNull(), line("X-Page-ID", _one_line(F.col("id")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("least"))), line("X-Refers-To-Page-ID", _one_line(F.col("least"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    rows.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(where + "/records")
    return Archive(where + "/records", name)


def field(header: Column, name: str) -> Column:
    """A header's field, null if it isn't there."""
    got = F.regexp_extract(header, rf"(?i)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.rlike(rf"(?i)\r\n{name}: "), got)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Records with their full payloads: header, digest, payload (a revisit's is
    that of the record it refers to), payload_digest computed from the payload
    read, record (the record's bytes as they stand in a WARC file). A payload
    that doesn't match its digest stops the read. An empty archive has no rows.
    """
    records = spark.read.parquet(archive.records)
    payloads = spark.table(archive.payloads)
    hot = records.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") > joins.HOT_ROWS)
    hot = stored(hot, "hot")
    if hot.isEmpty():
        both = records.join(payloads, "digest")
    else:
        counted = payloads.join(hot, "digest", "left").select("digest", "payload", F.coalesce("c", F.lit(1)).alias("c"))
        both = joins.join_groups(records, counted, ["digest"], "c", wide=True).select("digest", "header", "payload")
    seen = F.sha2("payload", 256)
    both = both.withColumn("payload_digest", F.when(seen == F.col("digest"), seen).otherwise(F.raise_error(F.lit("payload does not match its digest"))))
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")))


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n", re.I)
_START = re.compile(rb"(?:\A|(?<=\r\n))WARC/\d")


def inflated(raw: bytes) -> bytes:
    """What can be read of gzip members one after the other; bytes that aren't
    gzip stay as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(raw))
            out.append(d.flush())
        except zlib.error:
            break
        raw = d.unused_data
    return b"".join(out)


def records(raw: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Place, header and block of the records of a WARC file.

    A record whose length isn't told, or leads to where no record ends, ends
    where the next one begins. What lies between records, and a header without
    an end, are no records."""
    m = _START.search(raw)
    while m:
        at = m.start()
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head, body = raw[at : end + 4], end + 4
        n = _LENGTH.search(head)
        nxt = body + int(n[1]) + 4 if n else -1
        if n and raw[nxt - 4 : nxt] == b"\r\n\r\n":
            yield at, head, raw[body : nxt - 4]
            m = _START.search(raw, nxt)
        else:
            m = _START.search(raw, body)
            yield at, head, (raw[body : m.start()] if m else raw[body:]).removesuffix(b"\r\n\r\n")


def parse_warc(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Records of WARC files (rows of Spark's binaryFile source; gzip too):
    path, offset, header, block. For archives made elsewhere.

    Null and empty files have no records; a null path stays null; repeated files
    are read each by itself; extra columns, whatever their names, are ignored.
    Wrong lengths and cut or broken gzip lose no more than what can't be read
    (see records and inflated). A file is a row and so must fit into memory, as
    Spark's source asks; its records leave one at a time.
    """
    ship(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for at, head, block in records(inflated(data.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([at], pa.int64()), pa.array([head.decode("utf-8", "replace")]), pa.array([block], pa.binary())], names=["path", "offset", "header", "block"])

    return files.select(path_col, content_col).mapInArrow(run, "path string, offset long, header string, block binary")
