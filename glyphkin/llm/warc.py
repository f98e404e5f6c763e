"""Operator 10: WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, several frames make a bundle file, and the file ends in a
skippable frame with a seek table (sizes of all frames). The index maps a record's id to its bundle, frame and the
offset inside that frame, so one record is read with one frame decompressed and nothing else.

Of records with equal payloads of at least `min_revisit` bytes the one with the largest id is a response, the
others are revisits that refer to it; smaller payloads are always responses. Rows with the same id and payload are
records of their own with the same role; a null id never is the response of others that have one. A null payload is
empty, a null address is left out. Columns other than id, address and payload are not archived.

Bundles are written through pyarrow's file systems below one shared folder under names of their own, and count only
once the index, written by Spark's commit protocol, names them: a lost or repeated task leaves no trace in it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, stored, table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
MIN_REVISIT = 1000

# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id long, bundle string, frame int, at long, length long"
_INDEX_ARROW = pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers in lower case, and `payload` of a response."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    out: dict = dict((k.lower(), v) for k, v in (x.split(": ", 1) for x in lines[1:]))
    block = rest[: int(out["content-length"])]
    if len(block) != int(out["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    out["payload"] = block.partition(b"\r\n\r\n")[2]
    return out


class BundleWriter:
    """Collects records into frames; finish() appends the seek table and gives the whole bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.out, self.sizes, self.open, self.at, self.total = io.BytesIO(), [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length) of the record."""
        if self.open and self.at + len(record) > self.frame_bytes:
            self._close()
        place = (len(self.sizes), self.at, len(record))
        self.open.append(record)
        self.at += len(record)
        self.total += len(record)
        return place

    def _close(self) -> None:
        packed = self.press.compress(b"".join(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), self.at))
        self.open, self.at = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        return self.out.getvalue()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        sizes = list(struct.iter_unpack("<II", self._read(size - 9 - 8 * frames, 8 * frames)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.press, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def record(self, frame: int, at: int, length: int) -> dict:
        if self.last[0] != frame:
            start, packed, plain = self.frames[frame]
            self.last = (frame, self.press.decompress(self._read(start, packed), max_output_size=plain))
        return parse_record(self.last[1][at : at + length])

    def close(self) -> None:
        self.file.close()


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = MIN_REVISIT, salts: int = 16) -> DataFrame:
    """(record_id, url, payload, digest, refers_to): refers_to is null for responses.

    Only ids, digests and lengths are grouped; the groups are salted, as one payload may be a third of all.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.filter(F.octet_length("payload") >= min_revisit).select("record_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("record_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull())
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts))
    spread = groups.select("digest", "first", F.explode(F.array([F.lit(i).cast("long") for i in range(salts)])).alias("salt"))
    revisits = keys.withColumn("salt", salt).join(spread, ["digest", "salt"]).filter(~F.col("record_id").eqNullSafe(F.col("first")))
    revisits = revisits.select(F.col("record_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to")).distinct()
    return rows.join(revisits, F.col("record_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_id", "r_digest")


def write_archive(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles below the folder (a URI that all machines share) and returns the stored index."""

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)

        def flush(writer, rows):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(writer.finish())
            ids, places = zip(*rows)
            frames, at, length = zip(*places)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, [f"{folder}/{name}"] * len(ids), frames, at, length), _INDEX_ARROW)], schema=_INDEX_ARROW)

        writer, rows = BundleWriter(frame_bytes), []
        for b in batches:
            for rid, url, payload, digest, refers in zip(*(b.column(c) for c in ("record_id", "url", "payload", "digest", "refers_to"))):
                rows.append((rid.as_py(), writer.add(record_bytes(rid.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()))))
                if writer.total >= bundle_bytes:
                    yield flush(writer, rows)
                    writer, rows = BundleWriter(frame_bytes), []
        if rows:
            yield flush(writer, rows)

    return stored(records.mapInArrow(run, INDEX))


READ = "record_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read_archive(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index (or part of it) names; the digest of every response is verified.

    A revisit's payload is null; its length and digest are those of the payload that it stands for.
    """

    def urn(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("frame", "ascending"), ("at", "ascending")])
        reader = BundleReader(t.column("bundle")[0].as_py())
        rows = []
        for frame, at, length in zip(t.column("frame").to_pylist(), t.column("at").to_pylist(), t.column("length").to_pylist()):
            r = reader.record(frame, at, length)
            digest = r["warc-payload-digest"].removeprefix("sha1:")
            whole = r["warc-type"] == "response"
            if whole and hashlib.sha1(r["payload"]).hexdigest() != digest:
                raise ValueError("a payload doesn't match its digest")
            rows.append((urn(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], urn(r.get("warc-refers-to")), r["payload"] if whole and payloads else None, len(r["payload"]) if whole else int(r["x-payload-length"]), digest))
        reader.close()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return index.groupBy("bundle").applyInArrow(run, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, and read back from the archives."""
    records = with_roles(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    back = read_archive(write_archive(records, shared_dir(spark)), payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
