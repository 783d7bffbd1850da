"""WARC archives: captures written as records, and records assembled into transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRLF = "\r\n"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("declared_digest", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("block", T.BinaryType()),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
])


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1, by built-in functions.

    Forty hexadecimal digits are eight groups of twenty bits, four base-32 digits each.
    """
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0")
                        for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record's head, an empty line and its block; a null field is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    size = F.octet_length(block).cast("string")
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines,
                       F.concat(F.lit("Content-Length: "), size))
    return F.concat(head, F.lit(CRLF + CRLF), block)


def one_line(text: Column) -> Column:
    """A header value: line breaks and other controls become spaces."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", " ")


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = 0, records_per_file: int = 3000,
                   file_bytes: int = 256 << 20, compression: str = "gzip") -> None:
    """Write each row as a response or revisit record with its request and metadata records.

    Among payloads of equal digest and at least ``least`` bytes the smallest id is the response;
    the others are revisits of it without payload. Rows that repeat an id and payload are all
    responses, or all revisits. Files are WARC, gzipped whole, of at most ``records_per_file``
    captures, and fewer if the largest page could make that more than ``file_bytes``; Spark's
    committed writer writes them, so a lost task leaves no half of a file.

    Record ids are made of the page's id and the payload's digest, so a revisit refers to the
    record of its response by that record's own id, and a row that is repeated is written as the
    same capture again. Texts of any length are written whole. An empty table gives an archive
    without records.

    A null payload is empty; a null url is left out; a null id is written as an empty one and is
    never referred to unless no other id has its payload. Other columns are not read.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].alias("html"))
    digest = base32_sha1(body.cast("binary"))
    light = rows.select("id", digest.alias("digest"), F.octet_length(body).alias("size"))
    largest = light.agg(F.max("size")).first()[0] or 0
    records_per_file = max(1, min(records_per_file, file_bytes // (largest + 2048)))
    first = light.where(F.col("size") >= least).groupBy(F.col("digest").alias("fdigest")).agg(
        F.min("id").alias("first"))
    origin = light.distinct().join(first, F.col("digest") == F.col("fdigest"), "left").select(
        F.col("id").alias("oid"), F.col("digest").alias("odigest"), "first")
    revisits = origin.where(~F.col("oid").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    rows = rows.withColumn("digest", digest).join(
        revisits, F.col("id").eqNullSafe(F.col("oid")) & (F.col("digest") == F.col("odigest")),
        "left")

    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    capture = F.concat(F.lit("urn:capture:"), name, F.lit(":"), F.col("digest"))
    is_revisit = F.col("first").isNotNull()
    date = ("WARC-Date", F.lit(_DATE))
    uri = ("WARC-Target-URI", one_line(F.col("url")))

    def named(part: str) -> Column:
        return F.concat(F.lit("<"), capture, F.lit(f":{part}>"))

    head = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF * 2)
    main = _record([
        ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", named("main")), date, uri,
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(is_revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(is_revisit, F.concat(
            F.lit("<urn:capture:"), F.col("first").cast("string"), F.lit(":"), F.col("digest"),
            F.lit(":main>")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ], F.when(is_revisit, head).otherwise(F.concat(head, body)))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", named("request")), date, uri,
        ("WARC-Concurrent-To", named("main")),
        ("Content-Type", F.lit("application/http; msgtype=request")),
    ], F.concat(F.lit("GET "), F.coalesce(one_line(F.col("url")), F.lit("/")),
                F.lit(" HTTP/1.1" + CRLF * 2)))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", named("metadata")), date, uri,
        ("WARC-Concurrent-To", named("main")),
        ("Content-Type", F.lit("application/warc-fields")),
    ], F.concat(F.lit("page-id: "), name, F.lit(CRLF + "payload-length: "),
                F.octet_length(body).cast("string"), F.lit(CRLF)))
    between = CRLF + CRLF
    (rows.select(F.concat_ws(between, metadata, main, request).alias("value"))
     .write.option("lineSep", between).option("maxRecordsPerFile", records_per_file)
     .option("compression", compression).text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The head fields (names in lower case) and block of each record of one archive.

    A block's extent is its Content-Length, so it may hold anything. A cut archive raises.
    """
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's head is cut off")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        start = end + 4
        at = start + int(fields["content-length"])
        if at > len(data):
            raise ValueError("a record's block is cut off")
        yield fields, data[start:at]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``, with payload size and SHA-1 of responses.

    An archive, gzipped or not, is read whole by one task; the writer bounds its size. The payload is what
    follows the HTTP head. Digests of response payloads are those of the bytes read.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RECORD.fieldNames()
        kinds = [pa.binary() if n in ("block", "payload") else
                 pa.int64() if n == "payload_bytes" else pa.string() for n in names]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=names)

        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                for fields, block in parse_records(data):
                    kind = fields.get("warc-type")
                    payload = digest = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((
                        fields.get("warc-record-id"), kind, fields.get("warc-target-uri"),
                        fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
                        fields.get("warc-payload-digest"), fields.get("content-type"),
                        None if kind == "response" else block, payload,
                        None if payload is None else len(payload), digest))
                    size += len(block)
                    if size > 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return files.mapInArrow(parse, RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``main`` (its response or revisit record),
    ``requests`` and ``metadata`` (arrays of its records, by record id).

    Records belong to the capture whose record id they are concurrent to. A capture's own
    attendants are gathered by one aggregate and joined to its main record by that id; a request
    that names no main record, or a main record that nothing names, makes a row with what there
    is. An attendant that is written twice, id and block, is one. Captures stay as many as there
    are distinct ids, plus one for each repeated main record.
    """
    main = records.where(F.col("type").isin("response", "revisit", "resource")).select(
        F.col("record_id").alias("main_id"),
        F.struct(*RECORD.fieldNames()).alias("main"))
    attendant = F.struct("record_id", "target_uri", "content_type", "block")
    others = records.where(F.col("type").isin("request", "metadata")).groupBy(
        F.col("concurrent_to").alias("other_id")).agg(*[
            F.array_sort(F.collect_set(F.when(F.col("type") == kind, attendant))).alias(name)
            for kind, name in (("request", "requests"), ("metadata", "metadata"))])
    both = main.join(others, F.col("main_id") == F.col("other_id"), "full")
    return both.select(F.coalesce("main_id", "other_id").alias("capture_id"), "main", "requests",
                       "metadata")


def warc_field(block: Column, name: str) -> Column:
    """The value of one field of an application/warc-fields block; null if it is not there."""
    text = block.cast("string")
    found = F.regexp_extract(text, f"(?m)^{name}: ?([^\\r\\n]*)", 1)
    return F.when(found != "", found)
