"""WARC archives with revisit records for repeated payloads.

Headers (id, digest, size) are shuffled by payload digest, with the smallest
id of each digest taken before and after the shuffle; revisits join their
original's id back by digest, in a join whose hot digests adaptive execution
splits. Payloads move once, by page id, to meet the decision on their page.

A record is a header block, an empty line, a block and two line ends. Spark's
text writer, with those two line ends as its separator, so writes valid
WARC files to any file system, under its commit protocol: a task that is run
again leaves no second copy. Each file is one gzip stream. Files hold as many
records as make `file_bytes` on average; the reader takes the records of a
file one at a time, so a file of long ones needs no more memory.

Defined cases: a null html is an empty payload, a very long one a record like
any other; a null url is an empty one; rows with the original's own id are
responses like it, under its record id, as no record revisits itself; a null
id gets a record id of its own, and is never an original unless its digest has
no other; an empty table gives an archive without records; other columns of
pages are left out, whatever their names.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import shared_path

MIN_BYTES, FILE_BYTES = 100, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def headers(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )


def revisits(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, digest, refers_to and refers_url (the original's) of every
    record that revisits another."""
    long = heads.filter(F.col("size") >= min_bytes).select("page_id", "digest", "url")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = long.groupBy("digest").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    # Joined on the digest's bytes rather than its digits: both sides are then
    # dealt out for the join itself, which lets a hot digest be split.
    own = long.select("page_id", "digest", F.unhex("digest").alias("key"))
    found = own.join(first.select(F.unhex("digest").alias("key"), F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "key")
    return found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).drop("key").distinct()


def records(pages: DataFrame, *, min_bytes: int = MIN_BYTES, date: datetime | None = None, **names: str) -> DataFrame:
    """One `record` (text without its end) for each row of pages. date: of the
    records, by default now."""
    stamp = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = headers(pages, **names)
    found = revisits(heads, min_bytes).select(F.col("page_id").alias("page"), F.col("digest").alias("own"), "refers_to", "refers_url")
    all_ = heads.join(found, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("own")), "left")
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    record_id = F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {stamp}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("refers_url"), F.lit(f"\r\nWARC-Refers-To-Date: {stamp}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return all_.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("record"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, date: datetime | None = None, **names: str) -> None:
    """Write every page to archives under path."""
    html = names.get("html", "html")
    size = pages.agg(F.avg(F.coalesce(F.octet_length(f"`{html}`"), F.lit(0))).alias("b")).first()["b"] or 0
    each = max(1, int(file_bytes / (size + 600)))
    records(pages, min_bytes=min_bytes, date=date, **names).write.option("lineSep", END).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(archive):
    """(headers, block) of every record of an open archive, by its lengths."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:20]!r}")
        head = {}
        while (line := archive.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            head[name] = value
        yield head, archive.read(int(head[b"Content-Length"]))
        if archive.read(4) != END.encode():
            raise ValueError(f"the record {head[b'WARC-Record-ID']!r} doesn't end where it should")


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """A row for each record under path; a response's digest is computed from
    its payload and held against its header. payloads: with the html."""
    import pyarrow as pa

    ddl = ROW + (", html string" if payloads else "")

    def rows(batches):
        import gzip
        import hashlib

        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + ([("html", pa.string())] if payloads else []))
        for b in batches:
            for raw in b.column(0):
                out, held = [], 0
                for head, block in parse(gzip.open(pa.BufferReader(raw.as_buffer()))):
                    http, _, body = block.partition(b"\r\n\r\n")
                    type_, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    if type_ == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {head[b'WARC-Record-ID']!r} doesn't match its digest")
                    size = len(body) if type_ == "response" else int(http.rpartition(b"Content-Length: ")[2])
                    ids = [int(x[10:-1]) if x.startswith(b"<urn:page:") else None for x in (head.get(k, b"") for k in (b"WARC-Record-ID", b"WARC-Refers-To"))]
                    out.append({"page_id": ids[0], "url": head[b"WARC-Target-URI"].decode(), "payload_bytes": size, "payload_digest": digest, "record_type": type_, "refers_to": ids[1]} | ({"html": body.decode() if type_ == "response" else None} if payloads else {}))
                    held += len(body)
                    if payloads and held > FILE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(rows, ddl)


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write the archives of pages to the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **names)
    return read_archives(pages.sparkSession, path)
