"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the ``response`` (or ``revisit``) holds the payload, a ``request`` and a ``metadata`` record
name it in WARC-Concurrent-To.  ``read_records`` gives one row a record; ``assemble`` joins the three kinds through those
identifiers and gives one nested row a capture.

Archives are written by Spark's text writer with CR LF CR LF as the line separator, which is how a WARC record ends,
and compressed with gzip.  Gzip files aren't split, so a task reads whole records in order: the reader gets the pieces
between separators, puts them back together by Content-Length and never holds more than one record.

Payloads of at least ``REVISIT_BYTES`` are stored once: of the captures that share one, that with the largest page_id
(then url) is the response, the others are revisits that name it in WARC-Refers-To.

Defined results: a null html is an empty payload; a null url leaves out WARC-Target-URI; a null page_id is kept and is the
smallest; rows equal in page_id, url and html are captures of their own with the same identifiers, and each comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

END = "\r\n\r\n"
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("block", T.BinaryType()),
])


def _urn(kind: str, key: Column) -> Column:
    """A record identifier that follows from what the record is about, so a task that runs again names it alike."""
    h = F.md5(F.concat(F.lit(kind), key))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(pairs: list[tuple[str, Column | str]]) -> Column:
    """Named fields, one a line; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")) for name, value in pairs]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with ``copy``: a number from 0 of each of several rows that are equal.  Only those are gathered, as one row and a count."""
    same = ["page_id", "url", "digest"]
    twice = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*[F.col(c).alias(f"of_{c}") for c in same])
    twice = common.written(twice, "equal-rows")
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    match = [F.col("digest") == F.col("of_digest"), F.col("page_id").eqNullSafe(F.col("of_page_id")), F.col("url").eqNullSafe(F.col("of_url"))]
    gathered = rows.join(twice, match, "left_semi").groupBy(*same).agg(F.count(F.lit(1)).alias("k"), F.first("html").alias("html"), F.first("n").alias("n"))
    gathered = gathered.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")))).select(*rows.columns, "copy")
    return rows.join(twice, match, "left_anti").withColumn("copy", F.lit(0)).unionByName(gathered)


def write_captures(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives pages (page_id, url, html): a request, a response or revisit, and a metadata record each."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    rows = _numbered(rows)
    who = lambda page, at, digest, copy: F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(at, F.lit("-")), digest, F.when(copy > 0, copy.cast("string")))
    stored = (rows.where(F.col("n") >= revisit_bytes).select("digest", "page_id", "url").groupBy("digest")
              .agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("page_id", "url")).alias("first")).where("k > 1")
              .select(common.skew_key("digest").alias("same"), "first"))
    rows = rows.join(stored, F.col("digest") == F.col("same"), "left")
    revisit = F.expr("first IS NOT NULL AND NOT (first <=> struct(page_id, url) AND copy = 0)")
    key = who(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    response_id = _urn("response", key)
    answered = _urn("response", who(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(0)))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("fetch: archived\r\n"))
    target, size = ("WARC-Target-URI", F.col("url")), lambda c: F.octet_length(c).cast("string")
    request = F.concat(_head([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", key)), ("WARC-Date", date), target, ("WARC-Concurrent-To", response_id), ("Content-Type", "application/http;msgtype=request"), ("Content-Length", size(asked))]), asked)
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    answer = F.concat(_head([
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", response_id), ("WARC-Date", date), target,
        ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(revisit, answered)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]), http, body)
    metadata = F.concat(_head([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", key)), ("WARC-Date", date), target, ("WARC-Concurrent-To", response_id), ("Content-Type", "application/warc-fields"), ("Content-Length", size(about))]), about)
    (rows.select(F.concat_ws(END, request, answer, metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(folder))


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def parse(pieces: Iterator[bytes], blocks: bool) -> Iterator[tuple]:
    """Rows of RECORD from what stands between the separators of whole archives."""
    sep = END.encode()
    left: list[bytes] = []  # what was read beyond a block that ends in a part of a separator

    def following() -> bytes | None:
        return left.pop() if left else next(pieces, None)

    while (piece := following()) is not None:
        start = piece.find(b"WARC/1.")
        if start < 0:
            continue
        fields = _fields(piece[start:])
        need = int(fields.get("content-length", 0))
        parts, have = [], -len(sep)
        while have < need and (part := following()) is not None:
            parts.append(part)
            have += len(part) + len(sep)
        block = sep.join(parts)
        if rest := block[need:].removeprefix(sep):
            left.append(rest)
        block = (block + sep)[:need]
        kind = fields.get("warc-type")
        digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        size = page_id = None
        if kind == "response":
            payload = block.partition(sep)[2]
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        elif kind == "revisit":
            length = _fields(block).get("content-length")
            size = int(length) if length else None
        elif kind == "metadata":
            named = _fields(block).get("page-id")
            page_id = int(named) if named else None
        yield (fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), page_id, digest, size, block if blocks else None)


def read_records(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """A row for each record of gzip archives.  Digest and size are those of the payload as it was read; for a revisit,
    which has none, those it states.  blocks: also give the record's block."""
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]
        pieces = (x.as_py() for b in batches for x in b.column(0))
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=RECORD.names)

        for row in parse(pieces, blocks):
            held.append(row)
            size += len(row[-1] or b"") + 300
            if size > 4 << 20:
                yield closed()
                held, size = [], 0
        if held:
            yield closed()

    lines = spark.read.option("lineSep", END).text(folder).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``response`` (or revisit), its ``request`` and its list of ``metadata`` records.

    Requests and metadata are first gathered by the identifier they are concurrent to, so a repeated identifier makes no pairs;
    of several requests that with the smallest identifier stays, metadata records are listed in the order of theirs."""
    columns = [c for c in records.columns if c != "concurrent_to"]
    nested = F.struct(*columns)
    head = F.struct("record_id", "type", "target_uri", "date", "block")
    request = records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("request_of")).agg(F.min_by(head, "record_id").alias("request"))
    metadata = (records.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("metadata_of"))
                .agg(F.array_sort(F.collect_set(F.struct("record_id", "page_id", "block"))).alias("metadata")))
    captures = records.where("type in ('response', 'revisit')").select("record_id", nested.alias("response"))
    return (captures.join(request, F.col("record_id") == F.col("request_of"), "left")
            .join(metadata, F.col("record_id") == F.col("metadata_of"), "left")
            .select("record_id", "response", "request", "metadata"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages, reads the archives back and gives a row for each capture."""
    spark = pages.sparkSession
    folder = common.new_path(spark, "warc")
    write_captures(pages, folder)
    captures = (assemble(read_records(spark, folder, blocks=False))
                .select("record_id", "response", F.element_at("metadata", 1)["page_id"].alias("page_id"), F.col("request.target_uri").alias("url")))
    captures = common.written(captures.select("record_id", "page_id", "url", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest"), "captures")
    first = (captures.where("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("page_id").alias("refers_page"))
             .select(common.skew_key("of").alias("of"), "refers_page"))
    return (captures.join(first, F.col("refers_to") == F.col("of"), "left")
            .select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"), "url"))
