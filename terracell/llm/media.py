"""Media columns: archives of lossless images, read by byte ranges through a Spark data source.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are the samples of an 8-bit greyscale image
192 wide, stored as PNG.  The data source `media_archive` writes one tar archive for each task, beside it an index of
fixed-size entries (offset, length, checksum, id), and on commit a manifest of the archives of successful attempts; so
files of lost or repeated attempts are never read.

Reading plans partitions as byte ranges of archives from the manifest alone.  A task takes the members that begin in
its range from the index, streams them as Arrow batches of bounded bytes, and retries a member by itself, from its
offset, when a read fails or its checksum is wrong.

Folders are opened through pyarrow's file systems (file, hdfs, s3, ...).  Null texts count as empty: one row of
spaces.  Null and repeated ids are members like any other; an empty table gives archives without members and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import scratch_path, texts

WIDTH = 192
MANIFEST = "_archives.json"
#: Bytes of media that one Arrow batch holds, unless a single member is larger.
BATCH = 4 << 20

_ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("crc", "<u4"), ("named", "<u4"), ("doc_id", "<i8")])


# ---- the stored form


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """The samples as a PNG; a text chunk keeps the number of bytes before filling up."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    note = _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode())
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The samples of a PNG that encode_png wrote, and the bytes before filling up."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width, n_bytes = 8, b"", 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n_bytes = int(data[8:])
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes(), n_bytes


def feature_of(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit hash of 8 x 8 block means against their median."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    bands = np.array_split(image, 8) if len(image) >= 8 else [image] * 8
    blocks = np.array([b.reshape(len(b), 8, WIDTH // 8).mean(axis=(0, 2)) for b in bands]).ravel()
    bits = "".join("1" if x else "0" for x in blocks > np.median(blocks))
    return f"{len(image)}:{image.mean():.3f}:{image.std():.3f}:{int(bits, 2):016x}"


# ---- the data source


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Done(WriterCommitMessage):
    def __init__(self, name: str, size: int):
        self.name, self.size = name, size


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.tar"  # an attempt never meets another one's file
        entries: list[tuple] = []
        at = 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                    media = media.as_py()
                    info = tarfile.TarInfo(f"{len(entries)}-{doc_id}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    entries.append((at + len(head), len(media), zlib.crc32(media), doc_id is not None, doc_id or 0))
                    at += len(head) + len(media) + (-len(media) % 512)
            out.write(b"\0" * 1024)
        with files.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(entries, _ENTRY).tobytes())
        return _Done(name, at)

    def commit(self, messages) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m]).encode())

    def abort(self, messages) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m:
                for name in (m.name, f"{m.name}.idx"):
                    files.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int):
        self.path, self.range_bytes, self.retries = path, range_bytes, retries

    def partitions(self) -> list[_Range]:
        files, root = _open(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        step = self.range_bytes
        return [_Range(name, s, min(s + step, size)) for name, size in archives for s in range(0, size, step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:  # no members at all
            return
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), _ENTRY)
        own = index[np.searchsorted(index["offset"], partition.start) : np.searchsorted(index["offset"], partition.end)]
        held: list[list] = [[], [], []]
        size = 0
        archive = None
        for e in own:
            media, archive = self.member(files, f"{root}/{partition.name}", archive, int(e["offset"]), int(e["length"]), int(e["crc"]))
            for x, v in zip(held, (int(e["doc_id"]) if e["named"] else None, int(e["offset"]), media)):
                x.append(v)
            size += len(media)
            if size >= BATCH:
                yield self._batch(held)
                held, size = [[], [], []], 0
        if archive is not None:
            archive.close()
        if held[0]:
            yield self._batch(held)

    def member(self, files: pafs.FileSystem, path: str, archive, offset: int, length: int, crc: int):
        """The bytes of one member and the file to go on with; archive may be None.  A failed opening or read is tried
        again at this member, with the archive opened anew."""
        problem: Exception = OSError(path)
        for _ in range(self.retries + 1):
            try:
                if archive is None:
                    archive = files.open_input_file(path)
                media = archive.read_at(length, offset)
                if len(media) == length and zlib.crc32(media) == crc:
                    return media, archive
                problem = OSError(f"wrong checksum at byte {offset} of {path}")
            except OSError as e:
                problem = e
            if archive is not None:
                archive.close()
                archive = None
        raise problem

    @staticmethod
    def _batch(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.binary())], names=["doc_id", "offset", "media"])


class MediaArchive(DataSource):
    """Options: path; range_bytes, the bytes of a planned partition; retries of a member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("retries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


# ---- the operator


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            media = [encode_png(payload_of(t), len(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([0] * len(media), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "offset", "media"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for media in batch.column("media").to_pylist():
            payload, n = decode_png(media)
            row = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)
            for x, v in zip(out, row):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds))], names=["doc_id", *names])


def write_archives(docs: DataFrame, path: str) -> str:
    """Store the texts of docs as media in archives under path."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(_store, "doc_id long, offset long, media binary").write.format("media_archive").mode("append").option("path", path).save()
    return path


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, offset, media of each member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=path, **options).load()


def media_digests(docs: DataFrame) -> DataFrame:
    """Store docs in a new folder of the shared store, read it back, and describe what was read: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    spark = docs.sparkSession
    path = write_archives(docs, scratch_path(spark, "media"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_archives(spark, path).mapInArrow(_digests, schema)
