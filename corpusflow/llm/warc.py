"""WARC archives as seekable Zstandard bundles.

Each task writes one bundle: records are grouped into independent Zstandard frames, and a skippable
frame at the end lists the frames' sizes (the published seekable format), so any frame can be read
alone and any Zstandard tool reads the whole.  The index maps a record to bundle, frame and the
offset inside the unpacked frame.

Of records with equal payloads of at least ``SMALLEST`` bytes the one with the smallest page id is
the response, the others are revisits that carry its digest and length and no payload.  Only digests
and ids are compared; payloads move to join them only where repeated digests are too many to broadcast,
which Spark decides from the stored table's size.

Defined results
  NULL payloads are empty payloads; NULL URLs leave the header out; line ends in URLs are percent-encoded.
  Rows of the smallest id (a NULL id only if all are NULL) are responses, also if repeated: one record id,
  several records.  Very long payloads are a frame of their own.  An empty table gives no bundle.
"""
from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import file_system, shared_folder, stored

SMALLEST = 100
#: Bytes of records in a frame, unless one record has more.
FRAME = 1_000_000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMES = uuid.UUID("6f1c2a54-3b0e-5c52-9d0a-6f7f5b3e8a11")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

INDEX = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()),
                      T.StructField("path", T.StringType()), T.StructField("frame", T.LongType()),
                      T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                       T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
                       T.StructField("payload", T.BinaryType())])


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}|{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> tuple[str, bytes]:
    """Id and bytes of one record; a revisit where ``refers_to`` is given."""
    name = record_id(page, digest)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        block = f"{head}\r\n".encode()
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + END + block + END


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` and where the next one starts; the payload is checked against its digest."""
    stop = data.index(END, start)
    fields = dict(line.split(": ", 1) for line in data[start:stop].decode().split("\r\n")[1:])
    body = stop + len(END)
    block = data[body:body + int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block[block.index(END) + len(END):] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload}, \
        body + len(block) + len(END)


class BundleWriter:
    def __init__(self, folder: str, frame: int = FRAME, level: int = LEVEL):
        import zstandard
        self.folder, self.limit = folder, frame
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.system, self.place = file_system(folder)
        self.system.create_dir(self.place, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out = self.system.open_output_stream(f"{self.place}/.{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record inside it."""
        if self.parts and self.size + len(data) > self.limit:
            self._flush()
        self.parts.append(data)
        self.size += len(data)
        return len(self.frames), self.size - len(data)

    def _flush(self) -> None:
        if self.parts:
            packed = self.packer.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        """The seek table, then the final name: a reader never sees half a bundle."""
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.system.move(f"{self.place}/.{self.name}", f"{self.place}/{self.name}")


class Bundle:
    """Reads a bundle by frames."""

    def __init__(self, path: str):
        import zstandard
        self.unpacker = zstandard.ZstdDecompressor()
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * entry, size - 9 - count * entry)
        self.sizes = [struct.unpack_from("<II", table, entry * i) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return self.unpacker.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)

    def records(self):
        for i in range(len(self)):
            data, at = self.frame(i), 0
            while at < len(data):
                found, at = parse(data, at)
                yield found


def _write(batches, folder: str, frame: int):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int64()),
                        ("offset", pa.int64()), ("length", pa.int64())])
    writer = None
    rows: list[tuple] = []
    for batch in batches:
        for page, url, payload, digest, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to"))):
            writer = writer or BundleWriter(folder, frame)
            name, data = record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
            rows.append((name, page.as_py(), f"{folder}/{writer.name}", *writer.add(data), len(data)))
    if writer:
        writer.close()
    for start in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start:start + 10_000]), schema)], schema=schema)


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          frame: int = FRAME) -> DataFrame:
    """Write the pages as bundles into ``folder`` (shared); the index, one row per record."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = stored(rows.filter(F.octet_length("payload") >= SMALLEST).groupBy("digest")
                      .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"), "repeated-payloads")
    marked = rows.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")
    return stored(marked.mapInArrow(lambda batches: _write(batches, folder, frame), INDEX), "warc-index")


def _read(batches, payloads: bool):
    names = [f.name for f in RECORD if payloads or f.name != "payload"]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            for found in Bundle(path).records():
                rows.append([found[n] for n in names])
                held += found["payload_bytes"] if payloads else 100
                if held > 8_000_000:
                    yield _rows(rows, names)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, names)


def _rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names=names)


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the bundles in ``index``, read back bundle by bundle."""
    schema = T.StructType([f for f in RECORD if payloads or f.name != "payload"])
    bundles = stored(index.select("path").distinct(), "warc-bundles")
    # one task for each bundle: its rows are few bytes, the file behind it is not
    return bundles.repartition(max(1, bundles.count())).mapInArrow(lambda b: _read(b, payloads), schema)


def _fetch(batches):
    names = [f.name for f in RECORD]
    for batch in batches:
        rows = []
        for path, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset"))):
            found, _ = parse(Bundle(path).frame(frame), offset)
            rows.append([found[n] for n in names])
        if rows:
            yield _rows(rows, names)


def fetch(index: DataFrame) -> DataFrame:
    """Just the records of the index rows given: one seek table and one frame is read for each."""
    return index.mapInArrow(_fetch, RECORD)
