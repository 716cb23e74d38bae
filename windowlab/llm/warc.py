"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Every record ends with an empty line, so records are rows of text with that as separator and Spark's own writer makes
archives in any store.  Reading: tasks look for the magic at every place of an archive and emit the candidate's offset and
the offset of its successor, as its own length states it.  Only the first record of a file is known to be real; pointer
jumping over the pairs doubles the distance in every round and keeps what can be reached from there.  Magic inside a
payload is a candidate like any other, but no chain leads to it.

Results: null html is an empty payload; a null id or url is written as ``null`` and read back as null; rows that
repeat one id with one payload are all responses if it is the largest id; a cut-off record and all that follows it in
its file are not reachable; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from windowlab.llm.store import join_sizes, stored

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 1000
#: Records of one file, at most: a file is read as one row.
FILE_RECORDS = 5000
RECORD_ID = re.compile(r"<urn:page:(-?\d+)>")


def header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, payload, size, digest, refers): ``refers`` is set for revisits."""
    payload = F.coalesce(html_col, F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(url_col, r"[\x00-\x20\x7f]", "%20"), F.lit("null")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload.cast("binary")).alias("digest"),
    )
    same = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    held = join_sizes(rows, stored(same, "same"), "digest", "copies", "left")
    return held.select("id", "url", "payload", "size", "digest", F.when((F.col("size") >= least) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers"))


def record(r: DataFrame) -> DataFrame:
    """One text column: the record without the empty line that ends it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit("")))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.concat(header("WARC-Refers-To", page(F.col("refers"))), header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), header("WARC-Type", F.when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit"))), header("WARC-Record-ID", page(F.col("id"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")), header("WARC-Target-URI", F.col("url")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("refers").isNull(), F.lit("")).otherwise(revisit), header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return r.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """A record per page; of equal payloads of at least ``least`` bytes the one with the largest id is written, others refer to it."""
    record(roles(pages, id_col, url_col, html_col, least)).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(folder)


def fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, mark, value = line.partition(":")
        if mark:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def candidates(data: bytes) -> Iterator[tuple]:
    """(offset, successor, type, id, refers, url, bytes, digest, agrees) of every place where a record may begin.

    The successor is -1 where the stated length does not end with an empty line inside the file.
    """
    at = data.find(MAGIC)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = fields(data[at + len(MAGIC) : end]) if end >= 0 else {}
        length = head.get("content-length", "")
        if length.isdigit() and len(length) < 16 and data[end + 4 + int(length) : end + 8 + int(length)] == b"\r\n\r\n":
            to = end + 4 + int(length)
            gap = data.find(b"\r\n\r\n", end + 4, to)
            inner = fields(data[end + 4 : gap]) if gap >= 0 else {}
            stated, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), inner.get("content-length", "")
            if head.get("warc-type") == "revisit":
                digest, size, agrees = stated, int(size) if size.isdigit() else None, True
            else:
                payload = memoryview(data)[gap + 4 if gap >= 0 else to : to]
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                agrees = digest == stated
            ids = [RECORD_ID.fullmatch(head.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
            yield (at, to + 4, head.get("warc-type"), *(int(m[1]) if m else None for m in ids), head.get("warc-target-uri"), size, digest, agrees)
        else:
            yield (at, -1, None, None, None, None, None, None, False)
        at = data.find(MAGIC, at + 1)


CANDIDATES = "file bigint, offset bigint, next bigint, type string, id bigint, refers bigint, url string, size bigint, digest string, agrees boolean"


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of all archives."""
    files = spark.read.format("binaryFile").load(folder).select(F.xxhash64("path").alias("file"), "content")
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    schema = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = [(file, *c) for c in candidates(content.as_py())]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 5000]), schema)], names)

    return files.mapInArrow(run, CANDIDATES)


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) on the chain from offset 0, of (file, offset, next): each round jumps twice as far as the one before."""
    jumps = links.join(links.select("file", F.col("offset").alias("next")), ["file", "next"], "left_semi").select("file", "offset", "next")
    jumps = stored(jumps, "jumps")
    found = stored(links.filter("offset = 0").select("file", "offset"), "found")
    while True:
        more = found.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        if not more.limit(1).count():
            return found
        # after k rounds the first 2^k records of a file are found, and a jump passes 2^k records
        found = stored(found.unionByName(more), "found")
        over = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jumps = stored(jumps.join(over, ["file", "next"]).select("file", "offset", F.col("far").alias("next")), "jumps")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, type, id, refers, url, size, digest, agrees) of the real records.

    ``agrees``: the digest of the payload read equals the stated one.
    """
    all_ = stored(scan_archives(spark, folder), "candidates")
    return all_.drop("next").join(reachable(all_.filter("next >= 0").select("file", "offset", "next")), ["file", "offset"], "left_semi")
