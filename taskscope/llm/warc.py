"""WARC archives: written with revisit and continuation records, read back and reassembled.

Writing is columnar: of pages with equal payloads of `SHORTEST` bytes or more the one
with the smallest id is a `response`, the others are `revisit` records that refer to
it.  A response's block is an HTTP message whose body is sent in chunks; blocks of
more than `SEGMENT` bytes go on in `continuation` records.  Files are gzip streams of
at most `RECORDS` records, so a file's size has a bound.

Reading parses each file by its Content-Length fields.  Records that go on are grouped
by the id of their origin, ordered by segment number and checked against the total
length of the last segment; then the chunked framing is undone and the payload's
digest compared with the record's.  A missing segment, a wrong length or a wrong
digest is an error that names the record.

Nulls: a null page is an empty payload; a null id is written as `none` and never is
what others refer to; a null url leaves its field out.  Pages that agree in id and
payload are equal records and are all read back.  An empty table writes no records
and reads back empty.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 100
SEGMENT, CHUNK, RECORDS = 16384, 4096, 4096
END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """`value`: the text of each record, bytes as they are, without the two line ends after it."""
    p = pages.select("page_id", F.regexp_replace("url", r"[\r\n]+", "%0A").alias("url"),
                     F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    # only ids and digests are grouped, and combined before they move
    first = (p.filter(F.col("size") >= SHORTEST).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    p = p.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    body = F.expr(f"CASE WHEN size = 0 THEN '' ELSE array_join(transform(sequence(0, (size - 1) div {CHUNK}), k -> concat("
                  f"lower(hex(least({CHUNK}, size - k * {CHUNK}))), '\\r\\n',"
                  f" CAST(substring(payload, CAST(k * {CHUNK} + 1 AS INT), {CHUNK}) AS STRING), '\\r\\n')), '') END")
    block = F.when(revisit, F.concat(F.lit(f"{_HTTP}Content-Length: "), F.col("size"), F.lit(END * 2))) \
        .otherwise(F.concat(F.lit(f"{_HTTP}Transfer-Encoding: chunked{END}{END}"), body, F.lit(f"0{END}{END}")))
    p = p.select("page_id", "url", "digest", "first", revisit.alias("revisit"), block.cast("binary").alias("block"))
    p = p.withColumn("total", F.octet_length("block"))
    parts = F.expr(f"transform(sequence(0, (total - 1) div {SEGMENT}), k -> struct(k + 1 AS number,"
                   f" substring(block, CAST(k * {SEGMENT} + 1 AS INT), {SEGMENT}) AS content,"
                   f" (k + 1) * {SEGMENT} >= total AS last))")
    p = p.select("page_id", "url", "digest", "first", "revisit", "total", F.explode(parts).alias("s"))
    number, content = F.col("s.number"), F.col("s.content")
    origin = _id(F.col("page_id"), F.col("digest"))
    goes_on = F.col("total") > SEGMENT
    later = number > 1
    kind = F.when(later, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    return p.select(F.concat(
        F.lit(f"WARC/1.1{END}"), _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.when(later, F.concat(F.regexp_replace(
            origin, ">$", ":"), number.cast("string"), F.lit(">"))).otherwise(origin)),
        _field("WARC-Date", F.lit("1970-01-01T00:00:00Z")), _field("WARC-Target-URI", F.when(~later, F.col("url"))),
        _field("WARC-Payload-Digest", F.when(~later, F.concat(F.lit("sha256:"), "digest"))),
        _field("WARC-Profile", F.when(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(F.col("revisit"), _id(F.col("first"), F.col("digest")))),
        _field("WARC-Segment-Number", F.when(goes_on, number.cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(later, origin)),
        _field("WARC-Segment-Total-Length", F.when(later & F.col("s.last"), F.col("total").cast("string"))),
        _field("Content-Type", F.when(~later, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length(content).cast("string")),
        F.lit(END), content.cast("string")).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives below `path`, one or more per task."""
    (records(pages).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS).text(path))


_FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "url",
           "warc-payload-digest": "digest", "warc-refers-to": "refers_to", "warc-segment-number": "segment",
           "warc-segment-origin-id": "origin", "warc-segment-total-length": "total"}
_SCHEMA = ("type string, record_id string, url string, digest string, refers_to string, segment int,"
           " origin string, total long, block binary")
_ARROW = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("digest", pa.string()),
                    ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()),
                    ("total", pa.int64()), ("block", pa.binary())])


def parsed(data: bytes) -> Iterator[dict]:
    """Records of one uncompressed archive."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict = {}
        for line in data[at:head].decode().split(END)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        start = head + 4
        if len(data) < start + size or data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"wrong length of {fields.get('warc-record-id')}")
        row = {v: fields.get(k) for k, v in _FIELDS.items()}
        row["segment"] = int(row["segment"]) if row["segment"] else None
        row["total"] = int(row["total"]) if row["total"] else None
        yield row | {"block": data[start:start + size]}
        at = start + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below `path`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for row in parsed(zlib.decompress(content.as_py(), 31)):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, _SCHEMA)


def whole(found: DataFrame) -> DataFrame:
    """Records with whole blocks: continuations are joined to their origins, in order and checked."""
    alone = found.filter("segment IS NULL")
    parts = found.filter("segment IS NOT NULL").withColumn("_key", F.coalesce("origin", "record_id"))
    # equal records of repeated pages agree in every segment: one of each counts, as many times as it is there
    each = parts.groupBy("_key", "segment").agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.first(c).alias(c) for c in ("type", "record_id", "url", "digest", "refers_to", "origin", "total", "block")])
    joined = (each.groupBy("_key").agg(
        *[F.min(F.when(F.col("segment") == 1, F.col(c))).alias(c)
          for c in ("type", "record_id", "url", "digest", "refers_to", "_copies")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("_s")))
    good = F.expr("record_id IS NOT NULL AND total IS NOT NULL AND element_at(_s, -1).segment = size(_s)"
                  " AND aggregate(_s, 0L, (n, x) -> n + octet_length(x.block)) = total")
    block = F.expr("CAST(array_join(transform(_s, x -> CAST(x.block AS STRING)), '') AS BINARY)")
    checked = F.when(good, block).otherwise(
        F.raise_error(F.concat(F.lit("segments do not make up "), F.col("_key"))))
    return (joined.select("type", "record_id", "url", "digest", "refers_to", F.lit(None).cast("int").alias("segment"),
                          F.lit(None).cast("string").alias("origin"), "total", checked.alias("block"),
                          F.explode(F.expr("sequence(1L, _copies)")).alias("_"))
            .drop("_").union(alone))


def body(message: bytes) -> tuple[bytes | None, int]:
    """The payload of an HTTP message and its length; a revisit's message only tells the length."""
    head, _, rest = message.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    if fields.get(b"transfer-encoding", b"").lower() != b"chunked":
        return (rest or None), int(fields[b"content-length"])
    out, at = [], 0
    while True:
        line = rest.find(b"\r\n", at)
        size = int(rest[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            break
        if rest[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk has the wrong length")
        out.append(rest[at:at + size])
        at += size + 2
    payload = b"".join(out)
    return payload, len(payload)


def pages(found: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to (a page), payload, payload_bytes and payload_digest of whole records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [body(m) for m in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([p for p, _ in done], pa.binary()), pa.array([n for _, n in done], pa.int64())],
                names=[*b.schema.names[1:], "payload", "payload_bytes"])

    def page(name):
        return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:([^:]*):', 1) AS BIGINT)")

    out = found.select("block", "type", "record_id", "url", "digest", "refers_to").mapInArrow(
        run, "type string, record_id string, url string, digest string, refers_to string,"
             " payload binary, payload_bytes long")
    told = F.regexp_replace("digest", "^sha256:", "")
    digest = F.when(F.col("type") == "revisit", told).when(F.sha2("payload", 256) == told, told).otherwise(
        F.raise_error(F.concat(F.lit("wrong digest of "), F.col("record_id"))))
    return out.select(page("record_id").alias("page_id"), "url", F.col("type").alias("record_type"),
                      page("refers_to").alias("refers_to"), "payload", "payload_bytes", digest.alias("payload_digest"))
