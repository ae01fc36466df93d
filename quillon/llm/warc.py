"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: a response (or a revisit of an earlier response with the same payload), the request and a
metadata record; the latter two name the first in WARC-Concurrent-To. Archives are written by Spark's text writer, with the
blank lines that end a record as separator, and read back by its text reader, so any store that Spark reaches will do and
memory is bounded by one record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import save_stage, shared_path, ship_package, small

END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Records of one archive file: a gzip file is read by one task.
FILE_RECORDS = 12_000


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*parts)))
    return F.format_string("<urn:uuid:%s-%s-%s-%s-%s>", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x20\x7f]", "%20")


def _header(kind: Column, record: Column, block: Column, *fields: tuple[str, Column], content: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Type: "), content), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The rows of ``pages`` with payload digest, record id and, for a revisit, the response it refers to.

    Rows that agree in id, url and payload are captures of their own: they are counted, and each gets its place among them
    as part of its record id. Only the texts of such rows are shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", _record_id(F.col("page_id"), F.col("url"), F.col("digest")))
    again = save_stage(rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1"), "repeated")
    n = again.count()
    if n:
        once = rows.join(small(again, n).select("key"), "key", "left_anti").withColumn("place", F.lit(0))
        repeated = rows.join(small(again, n), "key").dropDuplicates(["key"]).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
        rows = once.unionByName(repeated)
    else:
        rows = rows.withColumn("place", F.lit(0))
    rows = rows.withColumn("record", F.when(F.col("place") == 0, F.col("key")).otherwise(_record_id(F.col("key"), F.col("place")))).drop("key")
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url", "place", "record")
    many = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = save_stage(many.select("digest", F.col("first.record").alias("first"), F.col("first.url").alias("first_url")), "payloads")
    out = rows.join(small(many, many.count()), "digest", "left")
    return out.withColumn("revisit", F.coalesce(F.col("first") != F.col("record"), F.lit(False)))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write the captures of ``pages`` as WARC 1.1 archives (gzip) under ``path``."""
    c = captures(pages, **columns)
    uri = _one_line(F.coalesce("url", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    target, digest = ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    response = _header(F.lit("response"), F.col("record"), F.concat(http, "payload"), target, digest, content=F.lit("application/http; msgtype=response"))
    revisit = _header(
        F.lit("revisit"), F.col("record"), http, target, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.col("first")),
        ("WARC-Refers-To-Target-URI", _one_line(F.coalesce("first_url", F.lit("")))), content=F.lit("application/http; msgtype=response"),
    )
    host = F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(uri == "", "/").otherwise(uri), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    with_first = ("WARC-Concurrent-To", F.col("record"))
    request = _header(F.lit("request"), _record_id(F.col("record"), F.lit("request")), asked, target, with_first, content=F.lit("application/http; msgtype=request"))
    known = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit("via: pages"))
    metadata = _header(F.lit("metadata"), _record_id(F.col("record"), F.lit("metadata")), known, target, with_first, content=F.lit("application/warc-fields"))
    records = c.select(F.explode(F.array(F.when(F.col("revisit"), revisit).otherwise(response), request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def parse(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, from (file, bytes between blank lines) in file order.

    A block may itself hold blank lines: chunks are joined until Content-Length is reached. A block that ends in a line end
    is cut before it, so the chunk that completes it also holds the next record's header. Chunks that begin no record are
    passed over; a record cut off at the end of its file is given with what is there.
    """
    file, fields, parts, size, want = None, None, [], 0, 0

    def begin(chunk: bytes) -> None:
        nonlocal fields, parts, size, want
        fields = None
        head = chunk.lstrip(b"\r\n")
        if head.startswith(b"WARC/"):
            fields, parts, size = _fields(head), [], -len(END)
            length = fields.get("content-length", "0")
            want = int(length) if length.isdigit() else 0

    for name, chunk in chunks:
        if name != file:
            if fields is not None:
                yield fields, END.encode().join(parts)
            file, fields = name, None
        if fields is None:
            begin(chunk)
            continue
        parts.append(chunk)
        size += len(END) + len(chunk)
        if size >= want:
            block = END.encode().join(parts)
            yield fields, block[:want]
            begin(block[want:])
    if fields is not None:
        yield fields, END.encode().join(parts)


_KINDS = "record string, kind string, concurrent_to string, refers_to string, target_uri string, named_digest string, page_id long, request_line string, payload_bytes long, payload_digest string"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for name, value in zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
                    yield name, value

        types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        names = [c.split()[0] for c in _KINDS.split(", ")] + ["payload"] * with_payload

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        rows, size = [], 0
        for fields, block in parse(chunks()):
            kind = fields.get("warc-type")
            named = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower() or None
            page, line, body, length, digest = None, None, None, None, named
            if kind == "response":
                _, _, body = block.partition(END.encode())
                length, digest = len(body), hashlib.sha256(body).hexdigest()
            elif kind == "revisit":
                length = _fields(block).get("content-length", "")
                length = int(length) if length.isdigit() else None
            elif kind == "metadata":
                page = _fields(block).get("page-id")
                page = int(page) if page and page.lstrip("-").isdigit() else None
            elif kind == "request":
                line = block.partition(b"\r\n")[0].decode("utf-8", "replace")
            row = [fields.get(k) for k in ("warc-record-id",)] + [kind] + [fields.get(k) for k in ("warc-concurrent-to", "warc-refers-to", "warc-target-uri")]
            rows.append([*row, named, page, line, length, digest, *([body] if with_payload else [])])
            size += len(block) if with_payload else 300
            if len(rows) >= 2000 or size > 8 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    return run


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``; payload length and digest are taken from the bytes that are there."""
    ship_package(spark)
    text = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.mapInArrow(_read(payload), _KINDS + (", payload binary" if payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture, joined through concurrent-to: ``record``, ``response``, ``request`` and ``metadata`` (structs).

    A response or revisit without request or metadata has null there; requests and metadata of no capture are left out;
    a record that is there more than once counts once.
    """
    first = records.filter("kind in ('response', 'revisit') and record is not null").dropDuplicates(["record"])
    body = [c for c in ("payload",) if c in records.columns]
    capture = first.select("record", F.struct("kind", "target_uri", "refers_to", "named_digest", "payload_bytes", "payload_digest", *body).alias("response"))
    linked = records.filter("concurrent_to is not null")
    request = linked.filter("kind = 'request'").dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("record"), F.struct("target_uri", "request_line", F.col("record").alias("id")).alias("request"))
    metadata = linked.filter("kind = 'metadata'").dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("record"), F.struct("page_id", F.col("record").alias("id")).alias("metadata"))
    return capture.join(request, "record", "left").join(metadata, "record", "left")


def op5_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble captures, and return one digest row per page.

    Null html is an empty payload. Repeated rows are captures of their own.
    """
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = save_stage(assemble(save_stage(read_records(spark, path, payload=False), "records")), "captures")
    rows = found.select("record", F.col("metadata.page_id").alias("page_id"), "response.*")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type")]
    plain = rows.filter("kind = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    origin = rows.filter("kind = 'response'").select(F.col("record").alias("refers_to"), F.col("page_id").alias("origin"))
    again = rows.filter("kind = 'revisit'").join(origin, "refers_to", "left").select(*columns, F.col("origin").alias("refers_to"))
    return plain.union(again)
