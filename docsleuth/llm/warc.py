"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Writing: a payload of at least MIN_BYTES that several pages share is stored once, with the page of the largest id;
the others become revisit records that refer to it by id and digest. Spark's text writer emits whole records, so
archives are committed task by task and survive lost executors; each file is one compressed stream of so many records as
make up FILE_BYTES on average.

Reading: files come as binary rows and are decompressed and cut into records piece by piece, by their content lengths, never by
looking for delimiters in payloads; a worker holds a compressed file and one record of it. Request and metadata records name their capture by WARC-Concurrent-To; one aggregation on
that identifier joins the three and gives one nested row a capture, two or more where identical rows were
written repeatedly.

A null payload is the empty one, a null url is empty, a null id has no field and is read as null. Line breaks in urls and ids
are written as percent codes; ids come back as they were.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.llm.common import shared_dir

MIN_BYTES = 1000
RECORDS_PER_FILE = 6000
FILE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Records that go from a worker to Spark at once, at most this many bytes of payload and one record.
BATCH_BYTES = 8 << 20


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, url: Column, content_type: str, block: Column, *more: tuple[str, Column | None]) -> Column:
    """One record without its last line feed, which the text writer adds."""
    head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF + "WARC-Record-ID: "), record_id, F.lit(CRLF + f"WARC-Date: {DATE}" + CRLF + "WARC-Target-URI: "), url]
    for name, value in more:
        head.append(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{CRLF}{name}: "), value)))
    head += [F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + "\r")]
    return F.concat(*head)


def one_line(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def as_field(v: Column) -> Column:
    """A value as text of one line; null is none."""
    return one_line(F.replace(v.cast("string"), F.lit("%"), F.lit("%25")))


def of_field(v: Column) -> Column:
    """as_field() undone."""
    return F.replace(F.replace(F.replace(v, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, records_per_file: int | None = None) -> None:
    """Archives below path; other columns are ignored. records_per_file: as many as make up FILE_BYTES, RECORDS_PER_FILE at most, unless given."""
    if records_per_file is None:
        mean = df.agg(F.avg(F.octet_length(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))).first()[0] or 0
        records_per_file = max(3, min(RECORDS_PER_FILE, int(3 * FILE_BYTES / (mean + 1))))
    pages = df.select(F.col(id_col).alias("id"), one_line(F.coalesce(F.col(url_col).cast("string"), F.lit(""))).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"size": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    shared = pages.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("kept")).where("n > 1").select("digest", F.col("kept.id").alias("kept_id"), F.col("kept.url").alias("kept_url"))
    joined = pages.join(shared, "digest", "left")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    own = _urn("response", text("id"), F.col("url"), F.col("digest"))
    revisit = F.col("kept_id").isNotNull() & ~F.col("kept_id").eqNullSafe(F.col("id"))
    rows = joined.select("*", own.alias("own"), revisit.alias("revisit"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    digest = F.concat(F.lit("sha1:"), F.upper("digest"))
    refers = F.when(F.col("revisit"), _urn("response", text("kept_id"), F.col("kept_url"), F.col("digest")))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    own_id = F.coalesce(F.concat(F.lit(CRLF + "pageId: "), as_field(F.col("id"))), F.lit(""))
    kept_id = F.when(F.col("revisit"), F.concat(F.lit(CRLF + "refersToPage: "), as_field(F.col("kept_id")))).otherwise(F.lit(""))
    fields = F.concat(F.lit("payloadLength: "), F.col("size").cast("string"), own_id, kept_id, F.lit(CRLF))
    main = _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("own"), F.col("url"), "application/http; msgtype=response", http, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers))
    request = _record("request", _urn("request", F.col("own")), F.col("url"), "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")), ("WARC-Concurrent-To", F.col("own")))
    metadata = _record("metadata", _urn("metadata", F.col("own")), F.col("url"), "application/warc-fields", fields, ("WARC-Concurrent-To", F.col("own")))
    rows.select(F.explode(F.array(request, main, metadata)).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, read one after the other; data may be compressed."""
    source = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if data[:2] == b"\x1f\x8b" else source
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


_RECORD = [("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("payload", pa.binary())]


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: its identifiers, and the payload (of a response the body, else the block) with size and SHA-1."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    kind = h.get("warc-type")
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
                    keep = with_payload or kind == "metadata"
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None, len(body), hashlib.sha1(body).hexdigest() if kind == "response" else None, body if keep else None))
                    size += len(body) * keep
                    if size > BATCH_BYTES or len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RECORD, strict=True)], names=[n for n, _ in _RECORD])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RECORD, strict=True)], names=[n for n, _ in _RECORD])

    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return files.mapInArrow(run, ", ".join(f"{n} {names[t]}" for n, t in _RECORD))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata structs, joined by concurrent-to."""
    kind = F.col("record_type")
    part = F.struct(*[n for n, _ in _RECORD])
    main = kind.isin("response", "revisit")
    grouped = found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.first(F.when(kind == "request", part), ignorenulls=True).alias("request"),
        F.first(F.when(main, part), ignorenulls=True).alias("response"),
        F.first(F.when(kind == "metadata", part), ignorenulls=True).alias("metadata"),
        F.count_if(main).alias("copies"),
    )
    fields = F.str_to_map(F.trim(F.col("metadata.payload").cast("string"), F.lit("\r\n")), F.lit("\r\n"), F.lit(": "))
    # identical rows share their identifiers; an incomplete capture still is a row
    return grouped.withColumn("fields", fields).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)))))


def page_digests(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """captures() as page_id, url, payload_bytes, payload_digest, record_type and refers_to; a revisit's size and digest are those of the payload it refers to."""
    response = F.col("response.record_type") == "response"
    own = lambda k: of_field(F.col("fields")[k]).try_cast(id_type)
    return found.select(
        own("pageId").alias("page_id"),
        F.col("response.url").alias("url"),
        F.when(response, F.col("response.payload_bytes")).otherwise(F.col("fields")["payloadLength"].cast("bigint")).alias("payload_bytes"),
        F.coalesce("response.payload_sha1", "response.header_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        own("refersToPage").alias("refers_to"),
    )


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes df's pages to a shared folder and reads the archives back, as page_digests()."""
    path = path or shared_dir(df.sparkSession)
    write(df, path, id_col, url_col, html_col)
    return page_digests(captures(records(df.sparkSession, path, with_payload=False)), df.schema[id_col].dataType.simpleString())
