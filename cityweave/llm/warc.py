"""WARC archives with revisit records for repeated payloads.

Writing: headers (never payloads) are shuffled by payload digest; of equal payloads of `REVISIT_BYTES` or more, the
record with the largest id stays a response and the others become revisits of it, which carry no payload. Payloads are
shuffled once, for the responses only, into archives of bounded size. Reading parses the archives byte by byte, checks
every digest, and joins revisits to their responses.

Archives are text files whose line separator is the blank lines that end a WARC record, so Spark's own writer, with its
commit protocol, stores them on any file system that Spark can write; gzip is its compression. An archive of many bytes
is read by one task, hence the bound on their size.

Defined cases: null html is an empty payload; null url an empty target; rows with the same id, url and payload are
records of their own, of which one is the response; of a group without ids, one is the response and the others refer to
a null id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.llm.base import fresh_path, map_batches, materialize, partitions_for

REVISIT_BYTES = 1000
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 16 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def urn(*parts: Column) -> Column:
    """A record id in the form of a UUID, made from the parts."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def header(kind: str, id_: Column, record: Column, url: Column, digest: Column, length: Column, more: list[tuple[str, Column]]) -> Column:
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("X-Page-ID", F.coalesce(id_.cast("string"), F.lit(""))), *more, ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length.cast("string"))]
    return F.concat(F.lit("WARC/1.1\r\n"), *(x for k, v in fields for x in (F.lit(f"{k}: "), v, F.lit("\r\n"))), F.lit("\r\n"))


def one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", "%0A")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip") -> None:
    """One record per row of pages, under path/responses and path/revisits.

    Files hold about `ARCHIVE_BYTES` of large payloads, or so many records that those of small ones and revisits stay below it."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), one_line(F.col(url_col)).alias("url"), body.alias("html"), F.octet_length(body).alias("n"), F.sha1(body.cast("binary")).alias("digest"))
    heads = materialize(p.drop("html").withColumn("row", F.monotonically_increasing_id()), "heads")
    order = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("o"), "id", "url", "row")
    best = heads.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max(order).alias("best"), F.count("*").alias("all"))
    marked = heads.join(best.where("all > 1"), "digest", "left")
    chosen = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.url") == F.col("url"))
    revisits = marked.where("best.row <> row")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    target = urn(F.lit("response"), F.col("best.id"), F.col("best.url"), F.col("digest"))
    more = [("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", target), ("WARC-Refers-To-Target-URI", F.col("best.url"))]
    record = urn(F.lit("revisit"), F.col("id"), F.col("url"), F.col("digest"), F.col("row"))
    lines = revisits.select(F.concat(header("revisit", F.col("id"), record, F.col("url"), F.col("digest"), F.octet_length(http), more), http).alias("value"))
    writer = {"lineSep": END, "compression": compression, "maxRecordsPerFile": ARCHIVE_BYTES // 1000}
    lines.write.options(**writer).text(f"{path}/revisits")

    n_bytes = pages.agg(F.sum(F.octet_length(html_col) + 500)).first()[0] or 0
    key = urn(F.lit("response"), F.col("id"), F.col("url"), F.col("digest"))
    p = p.withColumn("record", key)
    dropped = marked.where("best is not null").where(~chosen).select(key.alias("record")).distinct().withColumn("dropped", F.lit(True))
    # The one shuffle of payloads. (An anti join would be moved below it and bring a second one.)
    large = p.where(F.col("n") >= REVISIT_BYTES).repartition(partitions_for(spark, n_bytes, ARCHIVE_BYTES), "record").join(dropped, "record", "left").where("dropped is null").drop("dropped")
    # Rows of a chosen key that occur more than once: one of them keeps its payload.
    large = large.withColumn("copy", F.row_number().over(Window.partitionBy("record").orderBy("n"))).where("copy = 1").drop("copy")
    payload = large.unionByName(p.where(F.col("n") < REVISIT_BYTES))
    text = F.concat(header("response", F.col("id"), F.col("record"), F.col("url"), F.col("digest"), F.col("n") + F.octet_length(http), []), http, F.col("html"))
    payload.select(text.alias("value")).write.options(**writer).text(f"{path}/responses")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields, block) of each record of an uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length than it says")
        yield fields, view[start:stop]
        at = stop + 4


def read_archives(spark, path: str) -> DataFrame:
    """Records of the archives: page_id, record_id, record_type, url, payload_digest, payload_bytes (null for revisits), refers_to_record."""
    files = spark.read.format("binaryFile").load([f"{path}/responses", f"{path}/revisits"]).select("path", "content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to_record"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if name.endswith(".gz"):
                    data = zlib.decompress(data, 31)
                rows = []
                for f, block in parse(data):
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if f["WARC-Type"] == "response":
                        payload = block[bytes(block[:400]).index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't have its digest")
                    rows.append((int(f["X-Page-ID"]) if f["X-Page-ID"] else None, f["WARC-Record-ID"], f["WARC-Type"], f["WARC-Target-URI"], digest, size, f.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return map_batches(files, each, "page_id long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to_record string")


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take size and id from their response."""
    revisit = records.where("record_type = 'revisit'")
    response = records.where("record_type = 'response'")
    target = response.where(F.col("payload_bytes") >= REVISIT_BYTES).select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    found = revisit.join(target, revisit.refers_to_record == target.target, "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as archives, read them back, resolve the revisits."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_archives(spark, path))
