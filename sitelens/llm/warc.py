"""WARC archives in which repeated payloads are revisits of one response.

``resolve_revisits`` shuffles slim headers by payload digest: map-side aggregation
finds the original of each digest, one join brings it back to the records. Only
then are payloads read again and the archives written with fresh headers, through
Spark's text sink, so any store that Spark can write holds them.

Defined cases. A null payload is empty. Records with equal payloads of at least
``min_bytes``: the one with the smallest id is the response, all with another id
revisit it; rows repeated under the smallest id are all responses. A record
without id is never an original: it revisits one if there is one, else it is a
response. A null URL gives no target header; line breaks in a URL are escaped.
An empty table gives no archives and no rows. Further columns are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitelens.llm.common import prepared
from sitelens.session import scratch_path

# Fixed values of the WARC 1.1 format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

_RECORD = (
    "record_id string, record_type string, page_id bigint, url string, payload_bytes bigint,"
    " payload_digest string, refers_to_record string, payload binary"
)


def headers(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest`` of ``page_id, url, payload`` records."""
    payload = F.coalesce("payload", F.lit(""))
    return records.select(
        "page_id",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def resolve_revisits(slim: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, payload_digest, refers_to``: one row per revisit among ``headers``."""
    large = slim.filter(F.col("payload_bytes") >= min_bytes)
    # Groups of one need no join; a hot digest leaves one row per map task.
    originals = (
        large.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    return (
        large.select("page_id", "payload_digest")
        .join(originals, "payload_digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .distinct()
    )


def _record_id(page_id: Column) -> Column:
    text = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none"))).cast("binary"))
    parts = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record_text(date: str) -> Column:
    """The whole record without its closing blank lines, from resolved columns."""
    payload = F.coalesce("payload", F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit(f"{_VERSION}\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _line("X-Page-Id", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def write_archives(
    records: DataFrame,
    path: str,
    min_bytes: int = 100,
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = 1000,
) -> None:
    """Write ``page_id, url, payload`` rows as gzip-compressed deduplicated archives."""
    prepared(records.sparkSession)
    rows = records.select("page_id", "url", "payload")
    slim = headers(rows)
    revisits = resolve_revisits(slim, min_bytes).select(
        F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to"
    )
    whole = rows.withColumns(
        {
            "payload_bytes": F.octet_length(F.coalesce("payload", F.lit(""))).cast("long"),
            "payload_digest": F.sha2(F.coalesce("payload", F.lit("")).cast("binary"), 256),
        }
    )
    (
        whole.join(
            revisits,
            F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")),
            "left",
        )
        .select(record_text(date).alias("value"))
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _unpacked(content: bytes) -> bytes:
    """Plain bytes of an archive of any number of gzip members, or of none."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Records of one archive, cut by their stated lengths, so that payloads may hold anything."""
    data = _unpacked(content)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + 4
        at = start + int(fields["Content-Length"])
        _, _, payload = data[start:at].partition(b"\r\n\r\n")
        at += 4
        page = fields.get("X-Page-Id")
        if fields["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            http = data[start:at].decode().split("\r\n")
            size = int(next(x for x in http if x.startswith("Content-Length: "))[16:])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        yield (
            fields["WARC-Record-ID"],
            fields["WARC-Type"],
            int(page) if page is not None else None,
            fields.get("WARC-Target-URI"),
            size,
            digest,
            fields.get("WARC-Refers-To"),
            payload if fields["WARC-Type"] == "response" else None,
        )


def _parsed(payloads: bool):
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _RECORD.split(", ")]
    keep = len(names) - (not payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                columns = list(zip(*parse_archive(content.as_py()))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns[:keep], types[:keep])], names[:keep]
                )

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record; a response's size and digest come from its stored payload."""
    schema = _RECORD if payloads else _RECORD.rpartition(",")[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parsed(payloads), schema)


def with_originals(records: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the page of the response that a revisit record names."""
    originals = (
        records.filter("record_type = 'response'")
        .select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
        .distinct()
    )
    return records.join(originals, "refers_to_record", "left")


def deduplicated(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write ``records`` to the shared folder as archives and read those back."""
    spark = records.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(records, path, min_bytes)
    return with_originals(read_archives(spark, path))
