"""WARC archives: writing, reading back and assembling transactions.

``write_archives`` turns each page into a request, a response (or, for a payload
already stored elsewhere, a revisit) and a metadata record, linked by
WARC-Concurrent-To, and writes gzipped archives with Spark's text writer.
``read_records`` parses archives, one row per record, by Content-Length and
checks payload digests.  ``assemble`` brings request and metadata records together with
the response or revisit they name, in one exchange on that identifier, and gives one
nested row per capture; ``resolve`` joins revisits to the records they refer to.

A payload held by a third of all pages is one row after partial aggregation; the
join back is an inner join on the digest that adaptive execution may split.
Files hold about ``FILE_BYTES`` of payload and at most ``RECORDS_PER_FILE`` captures.

Defined results: a null html is the empty payload; of equal payloads of at least
``min_revisit_bytes`` bytes the largest page_id is the response (rows repeating
that page_id are responses too), others revisit it, and so do rows without a
page_id unless none has one; a null url is written as an empty one and control
characters in it are percent-encoded; repeated rows give one capture each; an
empty table gives an empty one; extra columns are not archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MIN_REVISIT_BYTES, RECORDS_PER_FILE, FILE_BYTES, SALTS = 1000, 4096, 64 << 20, 16
CRLF = "\r\n"


def choose_responses(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, size, the key of the row's records, and the response's key where the row revisits it.

    A key holds the row's place in the input, so that repeated rows have records of their own."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long"), "place": F.monotonically_increasing_id()})
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rows = rows.withColumn("key", F.concat_ws(":", F.lit("urn:page"), number, "digest", F.hex("place"))).drop("place")
    large = rows.where(F.col("size") >= min_revisit_bytes).select("digest", "page_id", "key")
    owner = large.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("owner"), F.count("*").alias("n")).where("n > 1 and owner.page_id is not null")
    revisit = F.col("owner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("owner.page_id")))
    joined = rows.join(owner.drop("n"), "digest", "left")
    return joined.withColumn("refers_to", F.when(revisit, F.col("owner.key"))).drop("owner")


def _record(kind: str | Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # a null value leaves its line out
    head += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write gzipped archives of about ``file_bytes`` of payload below ``path``; a failed task leaves nothing behind."""
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0.0
    records_per_file = max(1, min(RECORDS_PER_FILE, int(file_bytes // (mean + 1000))))
    rows = choose_responses(pages, min_revisit_bytes)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    host = F.coalesce(F.nullif(F.regexp_extract(safe, r"^\w+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    target = F.regexp_replace(safe, r"^\w+://[^/?#]*", "")
    uri = ("WARC-Target-URI", F.nullif(safe, F.lit("")))
    date = ("WARC-Date", F.lit("1970-01-01T00:00:00Z"))
    name = lambda kind: ("WARC-Record-ID", F.concat(F.lit("<"), "key", F.lit(f":{kind}>")))
    together = ("WARC-Concurrent-To", F.concat(F.lit("<"), "key", F.lit(":capture>")))
    stored = F.col("refers_to").isNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2),
        F.when(stored, F.col("html")).otherwise(F.lit("")),
    )
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    capture = [
        name("capture"), date, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Profile", F.when(~stored, F.lit(profile))),
        ("WARC-Refers-To", F.when(~stored, F.concat(F.lit("<"), "refers_to", F.lit(":capture>")))),
    ]
    request = F.concat(F.lit("GET "), F.coalesce(F.nullif(target, F.lit("")), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    about = F.concat(F.lit("page_id: "), number, F.lit(f"{CRLF}payload_bytes: "), F.col("size").cast("string"), F.lit(CRLF))
    text = F.concat_ws(
        CRLF * 2,
        _record("request", [name("request"), date, uri, together], "application/http; msgtype=request", request),
        _record(F.when(stored, F.lit("response")).otherwise(F.lit("revisit")), capture, "application/http; msgtype=response", http),
        _record("metadata", [name("metadata"), date, uri, together], "application/warc-fields", about),
    )
    out = rows.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, digest_ok boolean, payload_bytes long, page_id long, payload binary"


def parse(raw: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzipped (one or many members)."""
    if raw[:2] == b"\x1f\x8b":
        out = []
        while raw:
            member = zlib.decompressobj(31)
            out.append(member.decompress(raw))
            raw = member.unused_data
        raw = b"".join(out)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in raw[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        size = int(fields["Content-Length"])
        yield fields | {"block": raw[end + 4 : end + 4 + size]}
        at = end + 4 + size + 4


def _rows(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: dict[str, list] = {f.split()[0]: [] for f in RECORD.split(", ")}
                for rec in parse(content.as_py()):
                    kind, block = rec["WARC-Type"], rec["block"]
                    about = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if ": " in x) if kind == "metadata" else {}
                    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                    digest = rec.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    page = about.get("page_id")
                    for name, value in (
                        ("record_type", kind), ("record_id", rec["WARC-Record-ID"]), ("concurrent_to", rec.get("WARC-Concurrent-To")),
                        ("refers_to", rec.get("WARC-Refers-To")), ("target_uri", rec.get("WARC-Target-URI")), ("payload_digest", digest),
                        ("digest_ok", hashlib.sha1(payload).hexdigest() == digest if payload is not None else None),
                        ("payload_bytes", int(about["payload_bytes"]) if about else len(payload) if payload is not None else None),
                        ("page_id", int(page) if page and page != "none" else None), ("payload", payload if payloads else None),
                    ):
                        out[name].append(value)
                kinds = [pa.string()] * 6 + [pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the nested request, capture and metadata records (of several of one kind the greatest)."""
    kind = F.col("record_type")
    nested = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    main = kind.isin("response", "revisit")
    keyed = records.select(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id"), kind.alias("kind"), nested.alias("r"))
    one = lambda which, name: F.max(F.when(which, F.col("r"))).alias(name)
    k = F.col("kind")
    return keyed.groupBy("capture_id").agg(one(k == "request", "request"), one(k.isin("response", "revisit"), "capture"), one(k == "metadata", "metadata")).where("capture is not null")


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with refers_to_page: the page_id of the record that a revisit refers to, null where there is none.

    Many revisits may refer to one record, so both sides are salted."""
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(SALTS))
    named = captures.where("capture.refers_to is not null").select(F.col("capture.refers_to").alias("_id")).distinct()
    known = captures.where("capture.record_type = 'response'").select(F.col("capture_id").alias("_id"), F.col("metadata.page_id").alias("refers_to_page")).join(named, "_id")
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = (F.col("capture.refers_to") == F.col("_id")) & (salt == F.col("_salt"))
    return captures.join(known, on, "left").drop("_id", "_salt")


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to archives below ``path`` (default: the shared folder) and assemble them again."""
    spark = pages.sparkSession
    path = path or C.scratch(spark, "warc")
    write_archives(pages, path)
    return assemble(read_records(spark, path, payloads))


def query(spark, sf_dir: str) -> DataFrame:
    done = resolve(C.cut(round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))))
    response = F.coalesce("capture.payload_bytes", "metadata.payload_bytes")
    return done.select(
        F.col("metadata.page_id").alias("page_id"), response.alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN owner IS NOT NULL AND (page_id IS NULL OR page_id < owner) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS NOT NULL AND (page_id IS NULL OR page_id < owner) THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.h = o.h
"""
