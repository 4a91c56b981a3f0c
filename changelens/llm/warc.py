"""WARC archives: writing records in segments, and reading them back.

A record's block is an HTTP response whose body has chunked framing. A block of
more than ``SEGMENT`` bytes is cut: the first segment is the record itself, the
others are continuation records that name it as their origin, carry a segment
number, and at the end the total length. Records are written by Spark's text
writer, whose line separator is the end of a WARC record, as gzip files of a
bounded number of bounded records; each file is read whole by one task row.

Whole records are decoded where they are read. Only segments are shuffled: by
origin, ordered by number, verified against the total length, then joined and
freed of their chunks.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import map_arrow, shared_dir, table, written

SEGMENT, CHUNK, RECORDS_PER_FILE = 32 << 10, 8 << 10, 1024
#: Payloads from this size on are stored once.
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class Damaged(ValueError):
    """An archive does not hold what its headers say."""


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked transfer; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = framed.index(b"\r\n", at)
        size = int(framed[at:eol].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = framed[eol + 2 : eol + 2 + size]
        if len(part) != size or framed[eol + 2 + size : eol + 4 + size] != b"\r\n":
            raise Damaged("chunk")
        out.append(part)
        at = eol + 4 + size


def _record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its end, which the writer adds."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    clean = lambda v: " ".join(str(v).split())  # noqa: E731  a header value is one line
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head if v is not None) + "\r\n").encode("utf-8", "surrogatepass") + block


def records(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The record of a page, and its continuations. With ``refers_to`` it is a revisit without body."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", name, [*fields, ("WARC-Profile", profile), ("WARC-Refers-To-Page-ID", refers_to)], _HTTP + b"\r\n")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body)
    if len(block) <= SEGMENT:
        yield _record("response", name, fields, block)
        return
    yield _record("response", name, [*fields, ("WARC-Segment-Number", 1)], block[:SEGMENT])
    for n, at in enumerate(range(SEGMENT, len(block), SEGMENT), 2):
        total = len(block) if at + SEGMENT >= len(block) else None
        more = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        yield _record("continuation", f"<urn:uuid:{uuid.uuid4()}>", more, block[at : at + SEGMENT])


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the records of ``pages`` (page_id, url, html, digest, refers_to) below ``path``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = [r for page_id, url, html, digest, ref in rows for r in records(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, ref)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = map_arrow(pages.select("page_id", "url", "html", "digest", "refers_to"), run, "value binary")
    writer = rows.select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise Damaged("record start")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise Damaged("record length")
        yield head, block
        at = end + 8 + size


def payload(block: bytes) -> bytes:
    """The body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ = (
    "record_type string, page_id long, refers_to long, digest string, payload_bytes long, payload_digest string, "
    "origin string, number int, total long, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row of ``_READ`` for each record below ``path``: whole records decoded, segments with their block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in _READ.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        number = lambda v: None if v is None else int(v)
        for content in batch.column(0):
            rows = []
            for h, block in parse(gzip.decompress(content.as_py())):
                kind, part = h["warc-type"], number(h.get("warc-segment-number"))
                digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                row = [kind, number(h.get("warc-page-id")), number(h.get("warc-refers-to-page-id")), digest, None, None, None, part, number(h.get("warc-segment-total-length")), None]
                if part is not None:
                    row[6], row[9] = h.get("warc-segment-origin-id", h["warc-record-id"]), block
                elif kind == "response":
                    body = payload(block)
                    row[4], row[5] = len(body), hashlib.sha256(body).hexdigest()
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return map_arrow(files, run, _READ)


def reassembled(segments: DataFrame) -> DataFrame:
    """page_id, digest, payload_bytes, payload_digest of the records whose segments are given; raises on a gap or a wrong length."""
    part = F.struct("number", "block", "total", "page_id", "digest")
    groups = segments.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts")).select("parts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for parts in batch.column(0).to_pylist():
            block = b"".join(p["block"] for p in parts)
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                raise Damaged("segments")
            body = payload(block)
            rows.append((parts[0]["page_id"], parts[0]["digest"], len(body), hashlib.sha256(body).hexdigest()))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["page_id", "digest", "payload_bytes", "payload_digest"])

    return map_arrow(groups, run, "page_id long, digest string, payload_bytes long, payload_digest string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) plus digest and refers_to: of equal payloads the smallest page_id is stored.

    Rows that share that page_id too are all stored; a null page_id is never the smallest.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    twice = sums.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = sums.join(twice.select("digest", "first_id"), "digest", "left")
    same = F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(~same, F.col("first_id"))).select("page_id", "url", "html", "digest", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages``, read back from archives in the shared folder.

    A null html is an empty payload, a null url no target; repeated rows get a record each; other columns are ignored.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archives(with_revisits(pages), path)
    read = written(read_records(spark, path))
    whole = read.where("record_type = 'response' and number is null").select("page_id", "digest", "payload_bytes", "payload_digest")
    stored = whole.unionByName(reassembled(read.where("number is not null")))
    bad = F.when(F.col("digest") != F.col("payload_digest"), F.raise_error(F.lit("a payload does not fit its digest"))).otherwise(F.col("payload_digest"))
    stored = written(stored.withColumn("payload_digest", bad))
    again = read.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("digest").alias("d"))
    known = stored.select(F.col("page_id").alias("first_id"), F.col("digest").alias("first_digest"), "payload_bytes", "payload_digest").distinct()
    found = again.join(known, (F.col("refers_to") == F.col("first_id")) & (F.col("d") == F.col("first_digest")), "left")
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = stored.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(found.withColumn("record_type", F.lit("revisit")).select(*keep))


def op7_warc_segments(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
