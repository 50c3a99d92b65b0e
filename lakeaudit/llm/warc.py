"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writer: every task writes its rows to archives of about ``target_bytes``, each with its
own dictionary trained on the archive's first records (``DICT_SAMPLE`` records and
``DICT_SAMPLE_BYTES`` bytes at most). Archive names carry the task attempt, and the
manifest (one row per archive) is a table in the shared folder, so a lost executor's
archives are written again and half-written ones are never listed.

Reader: one task per archive of the manifest reads the file in blocks, loads the
dictionary, decodes one frame per record and checks each record: version line, required
headers, ``Content-Length`` against the block, the closing line breaks, the payload's
length and digest. A fault raises ``WarcError``.

Equal payloads: of the rows with one payload of at least ``min_revisit_bytes`` bytes the
one with the largest page_id is the response and the others are revisits without payload.
The largest id per digest is a grouped maximum, combined before the shuffle.

Defined cases: null html is the empty payload; a null url is written without target URI;
null page_ids are smaller than all others (all null: all are responses); rows that repeat
the largest page_id are all responses; empty tables give no archives and no rows; other
input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import cut, importable, shared_folder

# The skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_SAMPLE, DICT_SAMPLE_BYTES, DICT_BYTES = 400, 4 << 20, 32 << 10
READ_BLOCK = 1 << 20
ID_PREFIX = "urn:lakeaudit:page:"

MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, frame_start long, payload binary"
)


class WarcError(ValueError):
    """An archive, frame or record that breaks the format."""


def file_system(uri: str):
    """pyarrow's file system for a URI or a plain path, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Archives of one task: records wait until the dictionary's sample is full, then are compressed one by one."""

    def __init__(self, folder: str, name: str, target_bytes: int, level: int = 3):
        self.folder, self.name, self.target, self.level = folder, name, target_bytes, level
        self.fs, self.root = file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.done: list[tuple[str, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.count = 0
        self.out = self.packer = None

    def _start(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, self.waiting).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples to train on
            trained = b"".join(self.waiting)[:DICT_BYTES] or b"\0" * 8
        self.file = f"{self.name}-{len(self.done):05d}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None)
        head = zstandard.ZstdCompressor(level=self.level).compress(trained)
        self._put(struct.pack("<II", DICT_MAGIC, len(head)) + head)
        # write_content_size lets the reader check each frame's length
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True, write_checksum=True)
        waiting, self.waiting = self.waiting, []
        for record in waiting:
            self._frame(record)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _frame(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.count += 1

    def add(self, record: bytes) -> None:
        if self.packer is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if len(self.waiting) >= DICT_SAMPLE or self.waiting_bytes >= DICT_SAMPLE_BYTES:
                self._start()
        else:
            self._frame(record)
        if self.size >= self.target:
            self.close()

    def close(self) -> None:
        if self.waiting:
            self._start()
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.file}", self.count, self.size))
            self._open()


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, target_bytes: int = 32 << 20) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; the manifest of the archives."""
    importable(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = (
        rows.where(F.length("payload") >= min_revisit_bytes)
        .groupBy(F.col("sha1").alias("same"))
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    copies = cut(groups.where("n > 1").select("same", "last"), "copies")
    rows = rows.join(copies, F.col("sha1") == F.col("same"), "left").select(
        "page_id", "url", "payload", "sha1", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}", target_bytes)
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                kind = "response" if refers_to is None else "revisit"
                writer.add(record_bytes(page_id, url, payload, digest, kind, refers_to))
        writer.close()
        if writer.done:
            names, counts, sizes = map(list, zip(*writer.done))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "n_records", "n_bytes"])

    return cut(rows.mapInArrow(write, MANIFEST), "manifest")


def _frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every frame after the dictionary's."""
    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise WarcError(f"leading frame has magic {magic:#x}, not {DICT_MAGIC:#x}")
    raw = stream.read(size)
    if len(raw) != size:
        raise WarcError("dictionary frame is cut off")
    raw = bytes(raw)
    if raw[:4] == zstandard.FRAME_HEADER:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, left = 8 + size, b""
    while True:
        data = left or bytes(stream.read(READ_BLOCK))
        if not data:
            return
        start, frame, parts = at, reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at {start}: {e}") from e
            at += len(data)
            if frame.eof:
                left = frame.unused_data
                at -= len(left)
                break
            data = bytes(stream.read(READ_BLOCK))
            if not data:
                raise WarcError(f"frame at {start} is cut off")
        yield start, b"".join(parts)


def _id(value: str) -> int | None:
    if not value.startswith(f"<{ID_PREFIX}") or not value.endswith(">"):
        raise WarcError(f"record id {value!r}")
    value = value[len(ID_PREFIX) + 1 : -1]
    return None if value == "null" else int(value)


def parse_record(data: bytes) -> dict:
    """The checked parts of one decoded frame, which must hold exactly one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise WarcError(f"version line {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise WarcError(f"header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    kind, length = fields["warc-type"], fields["content-length"]
    if kind not in ("response", "revisit") or not length.isdigit():
        raise WarcError(f"type {kind!r}, length {length!r}")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or not http.startswith(b"HTTP/") or len(stated) != 1 or not stated[0].isdigit():
        raise WarcError("HTTP header")
    algorithm, _, digest = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1":
        raise WarcError(f"digest {algorithm!r}")
    if kind == "response" and (len(payload) != int(stated[0]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise WarcError(f"payload of {fields['warc-record-id']} does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError(f"revisit {fields['warc-record-id']} has a payload or refers to nothing")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _id(fields["warc-record-id"]),
        "url": url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": int(stated[0]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` names, checked; a revisit's payload is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("frame_start", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = file_system(archive)
                rows, held, count = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for start, data in _frames(stream):
                        row = parse_record(data) | {"archive": archive, "frame_start": start}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        count, held = count + 1, held + (len(data) if with_payload else 200)
                        if held >= READ_BLOCK << 2:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if count != expected:
                    raise WarcError(f"{archive} has {count} records, its manifest row says {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    importable(spark)
    tasks = max(1, manifest.count())
    return manifest.select("archive", "n_records").repartition(tasks, "archive").mapInArrow(read, RECORDS)


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, shared_folder(spark, "warc"), min_revisit_bytes)
    return read_archives(spark, manifest)
