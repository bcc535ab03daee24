"""WARC archives: writing captures and assembling transactions from the records.

Writing: each capture gives a request, a response (or revisit) and a metadata record; request and metadata
name the response through WARC-Concurrent-To.  Of captures with equal payloads of at least
``LEAST_SHARED`` bytes the one with the least page_id is the response; the others are revisit records without
payload that refer to it.  Records are built with Spark expressions and written by Spark's text writer as
gzip files of a bounded number of records, with the record end as line separator.

Reading: every file is parsed by its records' Content-Length; payload size and digest are taken from the payload.
Assembly joins the records of a transaction through their concurrent-to identifiers, whatever files they
lie in, and gives one nested row per capture.

Edge cases: a null html is an empty payload; a null url an empty target; rows that are wholly equal have equal
records and give as many equal captures; a null page_id is never a revisit or referred to; line breaks in a url
become %0D and %0A; a request or metadata record without response gives no capture; an empty table gives an
archive without records.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codedelta.llm.common import new_path, read_table, write_table

LEAST_SHARED = 100
RECORDS_PER_FILE = 3000
CRAWL_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
_RECORD = ("record_id string, kind string, capture_id string, refers_to string, target_uri string, date string, status int, "
           "payload_bytes long, payload_digest string, digest_ok boolean, page_id long, payload binary")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without its closing blank lines; headers with a null value are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {CRAWL_DATE}"), *[F.concat(F.lit(f"{n}: "), v) for n, v in headers],
             F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """One row ``value`` per record of the pages (page_id, url, html)."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    shared = (p.filter((F.col("n") >= least_shared) & F.col("page_id").isNotNull()).select("digest", "page_id", "url").groupBy("digest")
              .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("c"))
              .filter("c > 1").select(F.col("digest").alias("d"), "first"))
    shared = write_table(shared, "shared_payloads")
    p = p.join(shared, F.col("digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first.page_id"))
    own = _uuid(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest"))
    origin = _uuid(F.lit("capture"), F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]*)", 1)
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]*([^#\s]*)", 1)
    request = _record("request", _uuid(F.lit("request"), own), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)],
                      "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    response = _record(F.when(again, "revisit").otherwise("response"), own, [
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(again, origin))],
        "application/http; msgtype=response", F.concat(head, F.when(again, "").otherwise(F.col("html"))))
    metadata = _record("metadata", _uuid(F.lit("metadata"), own), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)],
                       "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    return p.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archive(pages: DataFrame, out: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    (records(pages).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(out))


def parse_records(raw: bytes):
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(headers["content-length"])
        yield headers, memoryview(raw)[end + 4:end + 4 + n]
        at = end + 4 + n + 4


def _parsed(with_payload: bool):
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in parse_records(gzip.decompress(content.as_buffer())):
                    kind, status, size, digest, ok, page, payload = h["warc-type"], None, None, None, None, None, None
                    if kind in ("response", "revisit"):
                        block = bytes(block)
                        top, _, body = block.partition(b"\r\n\r\n")
                        first, *rest = top.split(b"\r\n")
                        status = int(first.split()[1])
                        stated = h.get("warc-payload-digest", "").removeprefix("sha256:")
                        if kind == "response":
                            size, digest = len(body), hashlib.sha256(body).hexdigest()
                            ok, payload = digest == stated, body if with_payload else None
                        else:
                            size = next(int(x.split(b":")[1]) for x in rest if x.lower().startswith(b"content-length:"))
                            digest = stated
                    elif kind == "metadata":
                        fields = dict(x.partition(":")[::2] for x in bytes(block).decode().split("\r\n") if x)
                        page = int(fields["page-id"]) if fields.get("page-id", "").strip() else None
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to", h["warc-record-id"]), h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), h.get("warc-date"), status, size, digest, ok, page, payload))
                    held += len(payload or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_records(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), _RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, request, response, metadata, and for a
    revisit the page_id of the response that it refers to."""
    def of(*kinds, fields):
        return F.max(F.when(F.col("kind").isin(*kinds), F.struct(*fields)))
    # A transaction has a few records; equal rows of the input have equal ones.
    t = recs.groupBy("capture_id").agg(
        of("request", fields=["record_id", "date"]).alias("request"),
        of("response", "revisit", fields=["record_id", "kind", "date", "target_uri", "status", "payload_bytes", "payload_digest", "digest_ok", "refers_to", "payload"]).alias("response"),
        of("metadata", fields=["record_id", "page_id"]).alias("metadata"),
        F.count_if(F.col("kind").isin("response", "revisit")).alias("captures")).filter("captures > 0")
    t = t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("captures").cast("int")))).drop("copy", "captures")
    return t.withColumn("target_uri", F.col("response.target_uri"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds refers_to_page: the page_id of the response that a revisit refers to."""
    ids = captures.filter(F.col("response.refers_to").isNotNull()).select(F.col("response.refers_to").alias("id")).distinct()
    origins = captures.select(F.col("capture_id").alias("o"), F.col("metadata.page_id").alias("refers_to_page"))
    origins = origins.join(ids, F.col("o") == F.col("id"), "left_semi").dropDuplicates(["o"])
    return captures.join(origins, F.col("response.refers_to") == F.col("o"), "left").drop("o")


def query(spark, sf_dir: str) -> DataFrame:
    out = new_path(spark, "archive")
    write_archive(read_table(spark, sf_dir, "pages"), out)
    captures = write_table(assemble(read_records(spark, out).drop("payload").withColumn("payload", F.lit(None).cast("binary"))), "captures")
    c = resolve_revisits(captures)
    return c.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
                    F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
                    F.col("refers_to_page").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
