"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a sequential reader.

Spark's text sink writes the archives, so they can go to any store that Spark writes to and a lost executor's
task is simply run again: a row is a whole gzip member without its last byte, and the line separator is that
byte. (The last byte of a member is the high byte of its length modulo 2^32, 0 for records under 16 MiB;
larger records are written with their own separator.)
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, discard, partitions, rows, staged, table, work_dir

VERSION = b"WARC/1.1"
#: A fixed capture date, so that archives are the same in every run.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    number = rid.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def member(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the digest of the payload but no block."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8")]
    block = b"" if revisit else payload
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in head) + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, archive_bytes: int = 32 << 20) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives below path.

    Of equal payloads of at least min_revisit_bytes, the row with the smallest page_id becomes a response, the
    others revisit it (rows that repeat that page_id become responses too). Null html is an empty payload,
    null url leaves the header out, null page_ids come after all others. An empty table gives an empty folder. An
    archive has archive_bytes at most, or one record; its folder (archive=N) says which task made it.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumns({"size": F.length("payload").cast("long"), "digest": F.sha1("payload")})
    first = own.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    judged = own.select("page_id", "digest", "size").distinct().join(first, "digest", "left")
    later = judged.filter((F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    # Joined by page_id as well, so that a payload that a third of all pages share is dealt to all partitions.
    marked = own.join(later, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    schema = "archive long, line binary, last int"

    def pack(batches):
        from pyspark import TaskContext

        def records():
            archive, held = TaskContext.get().partitionId() << 24, 0
            for p, u, payload, f, d in rows(batches, "page_id", "url", "payload", "first", "_d"):
                m = member(p, u, payload, f, d is not None)
                if held and held + len(m) > archive_bytes:
                    archive, held = archive + 1, 0
                held += len(m)
                yield archive, m[:-1], m[-1]

        yield from batched(records(), arrow_schema(schema))

    made = staged(marked.select("page_id", "url", "payload", "first", "_d").mapInArrow(pack, schema), "warc-members")
    # The last bytes have at most 128 values; one, unless records reach 16 MiB, and none for an empty table.
    for last in [r.last for r in made.select("last").distinct().collect()] or [0]:
        lines = made.filter(F.col("last") == last).select("archive", F.col("line").cast("string"))
        lines.write.mode("append").option("lineSep", chr(last)).partitionBy("archive").text(path)


def read_records(pieces):
    """Records of one archive, from an iterable of byte strings: (headers, payload).

    Each gzip member is one record. Members are inflated piece by piece, framing follows Content-Length, and
    the block digest is verified; damage raises ValueError.
    """
    source = iter(pieces)
    data = b""
    while True:
        if not data:
            data = next(source, b"")
            if not data:
                return
            continue
        inflate, got = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            if not data:
                data = next(source, b"")
                if not data:
                    raise ValueError("the archive ends within a record")
            got += inflate.decompress(data)
            data = inflate.unused_data
        yield parse(bytes(got))


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError("a record's block differs from its digest")
    return headers, block


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, piece: int = 1 << 16) -> DataFrame:
    """Every record of the archives at path. A revisit's payload is null; its length and digest are kept.

    A file is read whole by one task (Spark's binaryFile source): write_archives keeps files to archive_bytes. An empty
    folder gives no records.
    """

    def read(batches):
        def records():
            for (content,) in rows(batches, "content"):
                view = memoryview(content)
                for h, block in read_records(bytes(view[i : i + piece]) for i in range(0, len(view), piece)):
                    digest = h["warc-payload-digest"].partition(":")[2]
                    revisit = h["warc-type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload differs from its digest")
                    yield page_of(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], page_of(h["warc-refers-to"]) if revisit else None, int(h["x-payload-length"]), digest, None if revisit else block

        yield from batched(records(), arrow_schema(RECORD))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
