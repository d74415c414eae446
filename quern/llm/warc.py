"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few hundred kB
of whole WARC records, closed by the seek table of the public seekable format
(a skippable frame with the sizes of all frames and a footer). The index maps a
record id to bundle, frame and the record's place within the unpacked frame, so
one record costs one footer and one frame.

A record is a ``response`` (an HTTP message whose body is the payload) or, when
an equal payload of at least ``revisit_from`` bytes belongs to a row with a
larger id, a ``revisit`` of that row's record with HTTP headers only. Equal
payloads are found by their digests; hot ones are broadcast, so no payload moves
because many rows share it. Every writing task makes bundles under names of its
own and reports them in the index: what a lost or repeated task leaves behind
isn't listed and is never read.

Reading goes by the index alone: a task opens a bundle, takes its seek table from
the footer, reads the frames that hold wanted records by byte range and cuts the
records at their frame-relative places.

Defined cases: a null payload is empty; a null url leaves out the target URI;
ids of any characters are percent-encoded in record ids, so an empty id isn't a
null one; a null id is below all ids; among repeated rows of the largest id the
last by file and place is the response; a payload of any length that a cell can
hold (2 GB) is one record in one frame, so sizes fit the table's 32 bits; an
empty table makes no bundle and reads back empty; other columns are ignored. The
input is read twice; rows are told apart by `storage.numbered`.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import storage

# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
INDEX = "row long, record_id string, page_id string, record_type string, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: str | None, row: int) -> str:
    return f"urn:quern:null:{row}" if page_id is None else f"urn:quern:page:{quote(page_id, safe='', errors='surrogatepass')}:{row}"


def id_of(record: str) -> str | None:
    _, _, kind, rest = record.split(":", 3)
    return None if kind == "null" else unquote(rest.rpartition(":")[0], errors="surrogatepass")


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def make_record(rid: str, url: str | None, payload: bytes, digest: bytes, refers: str | None, date: str) -> bytes:
    """The bytes of one WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{b32(digest)}")
    if refers:
        head += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in the unpacked bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, n = end + 4, int(head["Content-Length"])
        yield head, data[start : start + n]
        at = start + n + 4


class BundleWriter:
    """Groups records into frames and closes the bundle with its seek table."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.fill = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and place within it."""
        if self.open and self.fill + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.sizes), self.fill
        self.open.append(record)
        self.fill += len(record)
        self.total += len(record)
        return at

    def flush(self) -> None:
        if self.open:
            packed = self.pack.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.fill))
            self.open, self.fill = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """Place, packed and unpacked size of each frame, from a bundle's last bytes
    (all of the table must be in ``tail``)."""
    n, descriptor, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    at, out = 0, []
    for i in range(n):
        entry = len(tail) - 9 - (n - i) * width
        packed, size = struct.unpack_from("<II", tail, entry)
        out.append((at, packed, size))
        at += packed
    return out


def write(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", revisit_from: int = 0, date="2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below ``folder``; the index of what was written."""
    spark = pages.sparkSession
    storage.small_batches(spark)
    pages, number = storage.numbered(pages)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(number).alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    heads = storage.stage(spark, rows.where(F.octet_length("payload") >= revisit_from).select("digest", F.struct(F.col("id").isNotNull().alias("some"), "id", "row").alias("who")), "payloads")
    many = heads.groupBy("digest").agg(F.count("*").alias("n"), F.max("who").alias("who")).where("n > 1")
    many = storage.stage(spark, many.select("digest", "n", F.col("who.id").cast("string").alias("to_id"), F.col("who.row").alias("to_row")), "shared_payloads")
    rows = storage.lookup(rows, many, "digest", heads.count(), "n")
    far = (F.octet_length("payload") >= revisit_from) & (F.col("to_row") != F.col("row"))
    rows = rows.select("row", F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(far, F.struct("to_id", "to_row")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = pafs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        out, listed, name = BundleWriter(), [], f"bundle-{uuid.uuid4().hex}.warc.zst"

        def closed():
            with disk.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(out.close())
            return pa.RecordBatch.from_pylist(listed, schema=shape)

        shape = pa.schema([("row", pa.int64()), ("record_id", pa.string()), ("page_id", pa.string()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                row, pid, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                rid, to = record_id(pid, row), refers and record_id(refers["to_id"], refers["to_row"])
                record = make_record(rid, url, payload, digest, to, date)
                frame, at = out.add(record)
                listed.append({"row": row, "record_id": rid, "page_id": pid, "record_type": "revisit" if to else "response", "bundle": name, "frame": frame, "offset": at, "length": len(record)})
                if out.total >= BUNDLE_BYTES:
                    yield closed()
                    out, listed, name = BundleWriter(), [], f"bundle-{uuid.uuid4().hex}.warc.zst"
        if listed:
            yield closed()

    return storage.stage(spark, rows.mapInArrow(run, INDEX), "warc_index")


def _record(head: dict[str, str], block: bytes) -> dict:
    """A row of RECORDS; a response's payload is hashed anew and compared."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said, kind, rid = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], head["WARC-Record-ID"][1:-1]
    n = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != n or b32(hashlib.sha1(payload).digest()) != said):
        raise ValueError(f"{rid}: payload and digest differ")
    to = head.get("WARC-Refers-To")
    return {"record_id": rid, "page_id": id_of(rid), "url": head.get("WARC-Target-URI"), "record_type": kind, "refers_to": to and id_of(to[1:-1]), "payload_bytes": n, "payload_digest": said, "payload": payload if kind == "response" else None}


_SHAPE = pa.schema([(k, pa.string()) for k in ("record_id", "page_id", "url", "record_type", "refers_to")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def fetch(folder: str, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows ``wanted``, by their places: of each bundle the
    footer and only the frames that hold one of them are read."""
    spark = wanted.sparkSession
    # a bundle has a bounded number of records: those of BUNDLE_BYTES, and one more
    entries = wanted.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length"))).alias("at"))
    entries = storage.stage(spark, entries, "wanted")
    n = max(1, min(entries.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = pafs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for bundle, places in ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows)):
            with disk.open_input_file(f"{base}/{bundle}") as file:
                end = file.size()
                frames = struct.unpack("<I", file.read_at(4, end - 9))[0]
                table = seek_table(file.read_at(9 + 8 * frames, end - 9 - 8 * frames))
                for frame, found in groupby(places, key=lambda p: p["frame"]):
                    at, packed, size = table[frame]
                    data = unpack.decompress(file.read_at(packed, at), max_output_size=size)
                    rows = [_record(*next(parse_records(data[p["offset"] : p["offset"] + p["length"]]))) for p in found]
                    if not payloads:
                        for r in rows:
                            r["payload"] = None
                    yield pa.RecordBatch.from_pylist(rows, schema=_SHAPE)

    return entries.repartition(n, "bundle").mapInArrow(run, RECORDS)


def read(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records that ``index`` lists."""
    return fetch(folder, index, payloads)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all ``pages`` and read the archives back, a row per page."""
    folder = storage.new_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = read(folder, index, payloads=False)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT DISTINCT h, sha1(h) AS x FROM p),
b AS (
  SELECT h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(x, 1 + 5 * CAST(k // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS digest
  FROM d
), w AS (
  SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM w JOIN b USING (h)
"""
