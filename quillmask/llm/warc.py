"""WARC archives: records, a normaliser for monolithic gzip files, and a sidecar offset index.

Archives are rows of a written table (name, file bytes), so that they live in whatever store the cluster shares, a
lost task rewrites only its own, and each is bounded: ``ARCHIVE_BYTES`` of payload, or one larger record. A
monolithic archive is one gzip stream; the normaliser inflates it once, piece by piece, and writes every record as
its own gzip member. The sidecar index is a table of its own (archive, offset, length, record id), sorted by archive
and offset. Readers fetch single members through it.

Of pages with equal payloads the smallest page_id is stored as response, others as revisits that name it. Digests are
grouped without their payloads, so that a page in a third of all rows is one counted digest, and rows learn their
response by page_id and digest together.

An empty table gives an empty one. A null payload is empty, a null page_id sorts first and is written as ``null``.
Rows that repeat a first page_id are responses too. Line breaks in a url are dropped. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import NULL_ID, dropped, real_id, shared_dir, written

ARCHIVE_BYTES = 4 << 20
_URN = "urn:quillmask:page:"
_END = b"\r\n\r\n"


def _urn(page: int) -> str:
    return f"<{_URN}{'null' if page == NULL_ID else page}>"


def _page(urn: str | None) -> int | None:
    if urn is None:
        return None
    said = urn.strip("<>").removeprefix(_URN)
    return NULL_ID if said == "null" else int(said)


def record(page: int, url: str | None, payload: bytes, first: int, digest: str) -> bytes:
    """A response, or a revisit that names its response, which has no payload of its own."""
    revisit = page != first
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Target-URI: {(url or '').translate({10: None, 13: None})}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(first)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes cut anywhere."""
    buffer, need = bytearray(), 0
    for piece in pieces:
        buffer += piece
        while True:
            if not need:
                at = buffer.find(_END)
                if at < 0:
                    break
                if not buffer.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                fields = fields_of(bytes(buffer[:at]))
                need = at + 4 + int(fields["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError("the last record is cut off")


def fields_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip file of any number of members, in pieces of about ``step`` bytes."""
    at, engine = 0, zlib.decompressobj(31)
    while at < len(data) or engine.unconsumed_tail:
        chunk = engine.unconsumed_tail or data[at : at + step]
        at += 0 if engine.unconsumed_tail else step
        yield engine.decompress(chunk, step)
        while engine.eof:
            rest = engine.unused_data + data[at:]
            if not rest:
                return
            data, at, engine = rest, 0, zlib.decompressobj(31)
    if not engine.eof:
        raise ValueError("the gzip stream is cut off")


def gzip_member(data: bytes, level: int = 3) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def normalise(data: bytes) -> tuple[bytes, list[tuple[int, int, str]]]:
    """A file with a member for each record, and (offset, length, record id) of each."""
    out, index = bytearray(), []
    for rec in split_records(inflate(data)):
        member = gzip_member(rec)
        index.append((len(out), len(member), fields_of(rec[: rec.find(_END)])["warc-record-id"]))
        out += member
    return bytes(out), index


def parse(rec: bytes) -> dict:
    """What a record says of its payload; a response's payload is held against it."""
    at = rec.find(_END)
    fields = fields_of(rec[:at])
    block = rec[at + 4 : at + 4 + int(fields["content-length"])]
    http = block.find(_END)
    size = int(fields_of(block[:http])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        payload = block[http + 4 :]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{fields['warc-record-id']}: payload and headers disagree")
    return {"page": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to"))}


def assigned(pages: DataFrame) -> DataFrame:
    """page, first, url, digest (hex), html: each page with the first page of its payload."""
    p = pages.select(F.coalesce(pages["page_id"].cast("long"), F.lit(NULL_ID)).alias("page"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    ids = p.select("page", "digest")
    first = ids.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("last > first")
    revisits = ids.join(first.select("digest", "first"), "digest").where("page > first").distinct()
    return p.join(revisits.hint("merge"), ["page", "digest"], "left").select("page", F.coalesce("first", "page").alias("first"), "url", "digest", "html")


def monolithic(assigned_pages: DataFrame) -> DataFrame:
    """name, data: archives that are one gzip stream each."""

    def rows(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        engine, made, size = zlib.compressobj(1, zlib.DEFLATED, 31), bytearray(), 0
        for batch in batches:
            for page, first, url, digest, html in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = html.cast(pa.binary()).as_py()
                made += engine.compress(record(page.as_py(), url.as_py(), payload, first.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode()))
                size += len(payload) + 1
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([f"{part:06d}-{k:06d}.warc.gz"]), pa.array([bytes(made + engine.flush())])], names=["name", "data"])
                    engine, made, size, k = zlib.compressobj(1, zlib.DEFLATED, 31), bytearray(), 0, k + 1
        if size:
            yield pa.record_batch([pa.array([f"{part:06d}-{k:06d}.warc.gz"]), pa.array([bytes(made + engine.flush())])], names=["name", "data"])

    return assigned_pages.mapInArrow(rows, "name string, data binary")


def normalised(archives: DataFrame) -> DataFrame:
    """name, data, index: archives with a member for each record, and where each is."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record", pa.string())]))

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out, index = normalise(data.as_py())
                yield pa.record_batch([pa.array([name.as_py()]), pa.array([out]), pa.array([[{"offset": a, "length": n, "record": r} for a, n, r in index]], kind)], names=["name", "data", "index"])

    return archives.mapInArrow(rows, "name string, data binary, index array<struct<offset:long,length:long,record:string>>")


def sidecar(members: DataFrame) -> DataFrame:
    """name, offset, length, record of every member: reads the index alone, not the archives."""
    return members.select("name", F.explode("index").alias("at")).select("name", "at.*").sortWithinPartitions("name", "offset")


def read_back(archives: DataFrame, index: DataFrame) -> DataFrame:
    """Every record that the index lists, fetched from its archive (name, data)."""
    fields = [("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    listed = index.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))

    def rows(batches):
        for batch in batches:
            for data, at in zip(batch.column(0), batch.column(1), strict=True):
                file = data.as_py()
                out = [parse(b"".join(inflate(file[e["offset"] : e["offset"] + e["length"]]))) for e in at.as_py()]
                yield pa.record_batch([pa.array([r[n] for r in out], t) for n, t in fields], names=[n for n, _ in fields])

    out = archives.select("name", "data").join(listed.hint("merge"), "name").select("data", "at").mapInArrow(rows, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.select(real_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real_id("refers_to").alias("refers_to"))


def archived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the archives, normalise them, and return the normalised ones and their sidecar index as written tables."""
    spark, base = pages.sparkSession, shared_dir(pages.sparkSession)
    whole = written(monolithic(assigned(pages)), base, "monolithic")
    members = written(normalised(whole), base, "members")
    dropped(spark, f"{base}/monolithic")
    return members.select("name", "data"), written(sidecar(members), base, "sidecar")


def archive_report(pages: DataFrame) -> DataFrame:
    return read_back(*archived(pages))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
