"""WARC archives: writing captures, and assembling them again from their records.

A capture is a response (or revisit) record with the request and metadata records that name it in
WARC-Concurrent-To. Archives are written by Spark's text sink, whose record separator is set to the
two line ends that close a WARC record, so writing is atomic per task in any store that Spark can
write. They are read as binary files, parsed record by record, and the records of a transaction are
joined through their concurrent-to identifiers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import discard, materialize

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 100
RECORDS = "archive string, kind string, record_id string, concurrent_to string, refers_to string, target string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def _captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (never null), payload_bytes, payload_digest and own (the id of the row's capture) of each
    row. Of a page_id that several rows have, each gets the row's number into its id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("row", F.monotonically_increasing_id().cast("string"))
    again = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("again"))
    # Row numbers that others refer to are written first, so that they stay what they are.
    rows = rows.withColumn("again", F.lit(False)) if again.isEmpty() else materialize(rows, "pages").join(again, "page_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    more = F.when(F.col("page_id").isNull(), F.concat(F.lit("none:"), "row")).when(F.col("again"), F.concat(F.col("page_id").cast("string"), F.lit(":"), "row")).otherwise(F.col("page_id").cast("string"))
    rows = rows.withColumn("own", F.concat(F.lit("<urn:palimpsest:capture:"), more, F.lit(">"))).drop("row", "again")
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.col("payload"), 256))


def _firsts(captures: DataFrame, least_bytes: int) -> DataFrame:
    """payload_digest and first (smallest page_id, and the id of a capture of it) of the payloads of at least
    ``least_bytes`` that several pages have. Minima are combined before the shuffle."""
    large = captures.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    return large.groupBy("payload_digest").agg(F.min(F.struct("page_id", "own")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def _referring(captures: DataFrame, first: DataFrame) -> DataFrame:
    """Add refers_to and refers_own, of the first capture of an equal payload; null on rows of that page itself and
    without a page_id. A plain equi-join."""
    rows = captures.join(first, "payload_digest", "left")
    other = F.col("page_id") != F.col("first.page_id")
    return rows.withColumn("refers_to", F.when(other, F.col("first.page_id"))).withColumn("refers_own", F.when(other, F.col("first.own"))).drop("first")


def _header(*pairs: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out. Line ends within a value become blanks."""
    parts = [F.coalesce(F.concat(F.lit(f"{k}: "), F.regexp_replace(v.cast("string"), "[\r\n]+", " "), F.lit(END)), F.lit("")) for k, v in pairs]
    return F.concat(F.lit(f"WARC/1.1{END}"), *parts, F.lit(END))


def records(rows: DataFrame) -> DataFrame:
    """One string per capture: its response or revisit, request and metadata records, without the last two line ends."""
    page, url = F.col("page_id"), F.coalesce("url", F.lit("about:blank"))
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n ]+", "")
    request = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{END}{END}"))
    meta = F.concat(F.lit("payload-length: "), F.col("payload_bytes").cast("string"), F.lit(END))

    def length(x: Column) -> Column:
        return F.octet_length(x).cast("string")

    same = ("WARC-Date", F.lit(DATE))
    main = F.concat(
        _header(("WARC-Type", kind), ("WARC-Record-ID", F.col("own")), same, ("WARC-Target-URI", url), ("WARC-Page-ID", page),
                ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
                ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                ("WARC-Refers-To", F.col("refers_own")),
                ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", length(block))), block)
    asked = F.concat(_header(("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.concat(F.expr("substr(own, 1, length(own) - 1)"), F.lit(":request>"))), same, ("WARC-Target-URI", url), ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/http;msgtype=request")), ("Content-Length", length(request))), request)
    told = F.concat(_header(("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.concat(F.expr("substr(own, 1, length(own) - 1)"), F.lit(":metadata>"))), same, ("WARC-Target-URI", url), ("WARC-Concurrent-To", F.col("own")), ("Content-Type", F.lit("application/warc-fields")), ("Content-Length", length(meta))), meta)
    return rows.select(F.concat(main, F.lit(END * 2), asked, F.lit(END * 2), told).alias("value"))


def write_archives(pages: DataFrame, path: str, captures_each: int = 1000, least_bytes: int = LEAST_REVISIT, archive_bytes: int = 64 << 20) -> None:
    """Write a transaction per row of ``pages(page_id, url, html)`` to gzip archives in folders under ``path``.

    Null html is an empty payload; a null url is written as about:blank; a null page_id has no page field. Rows that
    repeat, also under one page_id, are captures of their own; an empty table writes nothing; further columns are
    ignored, whatever their names. An archive holds at most ``captures_each`` captures and, unless it is one capture,
    payloads of at most ``archive_bytes``: pages are written by classes of size, each of four times the one before, and
    the more to an archive the smaller they are.
    """
    rows = _captures(pages)
    first = materialize(_firsts(rows, least_bytes), "firsts")
    each = max(1, archive_bytes // captures_each)
    most = rows.agg(F.max("payload_bytes").alias("x")).first()["x"] or 0
    bounds = [each]
    while bounds[-1] < most:
        bounds.append(4 * bounds[-1])
    for k, bound in enumerate(bounds):
        size = F.col("payload_bytes")
        some = rows.where(size <= bound) if k == 0 else rows.where((size > bounds[k - 1]) & (size <= bound))
        records(_referring(some, first)).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", min(captures_each, max(1, archive_bytes // bound))).text(f"{path}/class-{k}")
    discard(first)


def _inflate(data: bytes) -> bytes:
    """All gzip members of an archive, or the bytes themselves if it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names lower-cased) and block of each record; raises ValueError on a broken archive."""
    data, at = _inflate(data), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, str] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        start = stop + 4
        end = start + int(fields["content-length"])
        if end > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, data[start:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True, flush: int = 8 << 20) -> DataFrame:
    """One flat row (``RECORDS``) per record of every archive under ``path``.

    payload is the HTTP body of a response, else the block. Digest and size are computed from it; for a
    revisit, which stores no payload, they are those its headers and metadata state. ``payloads=False``
    leaves payload null, so that a caller who wants digests alone doesn't move the bodies. An archive is inflated in
    memory, and its payloads are handed on about ``flush`` bytes at a time. A folder without archives gives no rows.
    """

    types = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

    def whole(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                out: list[list] = [[] for _ in types]
                held = 0
                for fields, block in parse(content):
                    kind = fields.get("warc-type", "")
                    http = fields.get("content-type", "").startswith("application/http")
                    body = block.partition(b"\r\n\r\n")[2] if http else block
                    digest: str | None = hashlib.sha256(body).hexdigest()
                    size: int | None = len(body)
                    if kind == "revisit":
                        digest, size = fields.get("warc-payload-digest", "").partition(":")[2] or None, None
                    more = {k: v for k, v in fields.items() if k.startswith("warc-page")}
                    if kind == "metadata":
                        more |= {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()}
                    one = (name, kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), list(more.items()), size, digest, body if payloads else None)
                    for column, value in zip(out, one, strict=True):
                        column.append(value)
                    held += len(body) if payloads else 0
                    if held > flush:
                        yield whole(out)
                        out, held = [[] for _ in types], 0
                yield whole(out)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(rows, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its own columns, ``request`` and ``metadata`` (null if missing).

    Records meet on the capture's id, their own for a response or revisit and the concurrent-to of the
    others. Of several requests or metadata records of a capture the one of the smallest record id is
    nested, and n_requests and n_metadata tell how many there were, so a capture that very many records
    name is combined before the shuffle. Archives written here have a record id per row; of foreign captures that
    repeat one there is one row. Requests and metadata without a capture are left out. A revisit takes its size from
    its metadata. No records give no rows; further columns of the records are ignored.
    """
    main = F.col("kind").isin("response", "revisit")
    one = records.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture is not null")
    kinds = {"main": main, "request": F.col("kind") == "request", "metadata": F.col("kind") == "metadata"}
    least = [F.min(F.when(on, F.struct("record_id", "kind", "target", "refers_to", "payload_bytes", "payload_digest", "payload", F.to_json("fields").alias("fields")))).alias(k) for k, on in kinds.items()]
    met = one.groupBy("capture").agg(*least, *(F.count(F.when(kinds[k], 1)).alias(f"n_{k}s".replace("as", "a")) for k in ("request", "metadata"))).where("main is not null")
    stated = F.get_json_object("metadata.fields", "$.payload-length").cast("long")
    return met.select("capture", F.col("main.kind").alias("kind"), F.col("main.target").alias("target"), F.get_json_object("main.fields", "$.warc-page-id").cast("long").alias("page_id"), F.col("main.refers_to").alias("refers_to"), F.coalesce("main.payload_bytes", stated).alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("main.payload").alias("payload"), "request", "metadata", "n_requests", "n_metadata")
