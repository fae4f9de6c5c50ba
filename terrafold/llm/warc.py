"""WARC archives: written with segments, chunked framing and revisits, and reassembled when read (op4).

Records are written by Spark's text writer with CR LF CR LF as the separator, which is what ends a WARC record; so files
lie wherever Spark can write.  Reading parses each file by Content-Length, groups continuation records by the id
of their origin, orders them by segment number, verifies the total length, and undoes the chunked transfer framing.

Defined results: null html is an empty payload; a null page_id is written as an empty field and read as null, and sorts
last among equal payloads; rows that repeat the smallest page_id of a payload are all responses; a record whose
segments, length or digest do not agree raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, shared_path, small_batches, staged

END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
BROADCAST_GROUPS = 200_000
CHUNK = 4096
PIECE = "origin string, seg int, total long, block binary, page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long"
_PIECE = pa.schema([("origin", pa.string()), ("seg", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        n = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(kind: str, record: str, length: int, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode("utf-8", "surrogatepass") + END


def records(page_id, url, payload: bytes, refers_to, is_revisit: bool, record: str, segment_bytes: int):
    """The records of one page, without the separator that ends each."""
    digest = digest_of(payload)
    fields = {"WARC_Target_URI": " ".join((url or "").split()), "WARC_Payload_Digest": f"sha1:{digest}", "WARC_Page_Id": "" if page_id is None else page_id}
    if is_revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
        extra = {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To_Page_Id": refers_to}
        yield _head("revisit", record, len(block), **fields, **extra) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield _head("response", record, len(block), **fields) + block
        return
    yield _head("response", record, len(parts[0]), **fields, WARC_Segment_Number=1) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        own = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record}/{k}')}"
        total = len(block) if k == len(parts) else None
        yield _head("continuation", own, len(part), WARC_Segment_Origin_ID=f"<{record}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total) + part


def parse(data: bytes):
    """(fields, block) of each record; field names in lower case."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "surrogatepass").partition(":") for x in lines)}
        start = stop + len(END)
        end = start + int(fields["content-length"])
        if data[end : end + len(END)] != END:
            raise ValueError("a record does not end where it says")
        yield fields, data[start:end]
        at = end + len(END)


def _inflate(data: bytes) -> bytes:
    """One or more gzip members; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) if out else data


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 8192, min_revisit_bytes: int = 0, records_per_file: int = 4000) -> None:
    """pages: page_id, url, html.  Of equal payloads of at least min_revisit_bytes, the smallest page_id is the response."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id")
    groups = staged(groups, "payload-groups")
    rows = rows.join(bounded_broadcast(groups.withColumn("grouped", F.lit(True)), groups.count(), BROADCAST_GROUPS), "sha", "left")
    rows = rows.select("page_id", "url", "payload", "first_id", (F.col("grouped").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_revisit"))

    def make(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for page_id, url, body, first, again in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                n += 1
                record = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{n}/{page_id}')}"
                out += records(page_id, url, body, first, again, record, segment_bytes)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _number(x):
    return int(x) if x else None


def _read(batches):
    for b in batches:
        for data in b.column(0):
            rows = []
            for fields, block in parse(_inflate(data.as_py())):
                kind = fields["warc-type"]
                seg = _number(fields.get("warc-segment-number"))
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                row = [origin, seg or 0, _number(fields.get("warc-segment-total-length")), None, _number(fields.get("warc-page-id")), None if kind == "continuation" else kind, fields.get("warc-payload-digest", "").removeprefix("sha1:"), _number(fields.get("warc-refers-to-page-id")), None]
                if kind == "revisit":
                    row[-1] = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                elif seg is None:
                    row[-1] = len(_verified(payload_of(block), row[6], origin))
                else:
                    row[3] = block
                rows.append(row)
                if len(rows) >= 256:
                    yield _batch(rows, _PIECE)
                    rows = []
            yield _batch(rows, _PIECE)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _verified(payload: bytes, digest: str, origin: str) -> bytes:
    if digest_of(payload) != digest:
        raise ValueError(f"the payload of {origin} does not have the digest that its record states")
    return payload


def reassemble(pieces: list[dict]) -> bytes:
    """The block of one record from its segments, in any order."""
    pieces = sorted(pieces, key=lambda p: p["seg"])
    if [p["seg"] for p in pieces] != list(range(1, len(pieces) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(p["block"] for p in pieces)
    if pieces[-1]["total"] != len(block):
        raise ValueError("the segments do not add up to the total length")
    return block


def _assemble(batches):
    for b in batches:
        rows = []
        for pieces in b.column(0).to_pylist():
            head = min(pieces, key=lambda p: p["seg"])
            n = head["payload_bytes"]
            if head["seg"]:
                n = len(_verified(payload_of(reassemble(pieces)), head["payload_digest"], head["origin"]))
            rows.append([head["page_id"], n, head["payload_digest"], head["record_type"], head["refers_to"] if head["record_type"] == "revisit" else None])
        yield _batch(rows, _PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit, of archives that this module or others wrote."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    pieces = files.mapInArrow(_read, PIECE)
    columns = [c.split()[0] for c in PIECE.split(", ")]
    return pieces.groupBy("origin").agg(F.collect_list(F.struct(*columns)).alias("pieces")).select("pieces").mapInArrow(_assemble, PAGE)


def round_trip(pages: DataFrame, segment_bytes: int = 8192, min_revisit_bytes: int = 0) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes, min_revisit_bytes)
    return read_archives(pages.sparkSession, path)
