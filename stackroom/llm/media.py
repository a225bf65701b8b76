"""Media members in archives, written and read by a data source of their own.

An archive is a ZIP file of stored members with its directory at the end.  Writing tasks
name their archives uniquely, and only a commit lists them, so repeated or failed tasks
leave nothing that is read.  Reading plans byte ranges over the archives: the driver
knows archives, not members.  The task of a range looks up the members that start in it
in the archive's directory, reads them in large blocks, checks each, and reads a
damaged one again, alone, at its offset.

The media here are 8-bit grey images, 192 samples wide, whose samples are the bytes of a text.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stackroom.llm.common import ready
from stackroom.session import new_run_dir

WIDTH = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 3
LISTING = "archives.json"
PNG_MARK = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
MEMBERS = "doc_id bigint, n_bytes bigint, archive string, offset bigint, media binary, attempts int, error string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """Grey image of 8-bit samples; the payload's length is a positive multiple of ``width``."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(samples), width + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return PNG_MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of an image that :func:`to_png` made, as lines of its width."""
    if not media.startswith(PNG_MARK):
        raise ValueError("not an image of this kind")
    at, body, size = len(PNG_MARK), [], (0, 0)
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += length + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return lines[:, 1:]


def padded(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and it filled up with spaces to a positive multiple of ``width``."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % width if raw else width)


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id, n_bytes, media) into archives of about ``ARCHIVE_BYTES``."""

    def __init__(self, options):
        self.uri = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder, recursive=True)
        done, archive = [], None
        for batch in iterator:
            for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = store.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED)
                    members = size = 0
                member = zipfile.ZipInfo(f"{members}_{'' if doc_id is None else doc_id}_{n_bytes}.png")
                archive.writestr(member, media)
                members, size = members + 1, size + len(media)
                if size >= ARCHIVE_BYTES:
                    done.append(self._close(archive, stream, name))
                    archive = None
        if archive is not None:
            done.append(self._close(archive, stream, name))
        return Written(done)

    @staticmethod
    def _close(archive, stream, name) -> tuple[str, int]:
        archive.close()
        size = stream.tell()
        stream.close()
        return name, size

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder, recursive=True)
        listed = sorted(a for m in messages if m for a in m.archives)
        if store.get_file_info(f"{folder}/{LISTING}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{folder}/{LISTING}") as old:
                listed = [*json.loads(old.read()), *listed]
        with store.open_output_stream(f"{folder}/{LISTING}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.uri)
        for name, _ in (a for m in messages if m for a in m.archives):
            store.delete_file(f"{folder}/{name}")


class _Forward(io.RawIOBase):
    """A stream that can only be appended to, for any file system."""

    def __init__(self, stream):
        self._stream = stream

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self._stream.write(bytes(data))
        return len(data)


@dataclass
class Range(InputPartition):
    archive: str
    size: int
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"].rstrip("/")
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[Range]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(f"{folder}/{LISTING}") as listing:
            archives = json.loads(listing.read())
        ranges = [Range(n, s, at, min(s, at + self.step)) for n, s in archives for at in range(0, s, self.step)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, folder = fs.FileSystem.from_uri(self.uri)
        path = f"{folder}/{partition.archive}"
        with store.open_input_file(path) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.start <= m.header_offset < partition.end]
            members.sort(key=lambda m: m.header_offset)
            rows, held = [], 0
            block_at, block = 0, b""
            for member in members:
                at = member.header_offset
                need = 30 + len(member.filename.encode()) + member.compress_size
                if at + need > block_at + len(block):
                    file.seek(at)
                    block_at, block = at, file.read(max(need, BLOCK_BYTES))
                media, error = _checked(block[at - block_at : at - block_at + need], member)
                tries = 1
                while media is None and tries < self.attempts:
                    tries += 1
                    media, error = self._again(store, path, at, need, member)
                _, doc_id, n_bytes = member.filename.removesuffix(".png").split("_")
                rows.append((int(doc_id) if doc_id else None, int(n_bytes), partition.archive, at, media, tries, error))
                held += need
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    @staticmethod
    def _again(store, path, at, need, member):
        try:
            with store.open_input_file(path) as file:
                file.seek(at)
                return _checked(file.read(need), member)
        except OSError as failure:
            return None, str(failure)


def _checked(raw: bytes, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """The member's bytes if they are whole, else what is wrong."""
    if raw[:4] != b"PK\x03\x04":
        return None, "no member at its offset"
    name, extra = struct.unpack_from("<HH", raw, 26)
    media = raw[30 + name + extra :][: member.compress_size]
    if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
        return None, "damaged member"
    return media, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    names = [part.split()[0] for part in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options range_bytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(MediaArchive)


def store(docs: DataFrame, folder: str) -> None:
    """Write the texts of (doc_id, text) as images into archives under ``folder``.

    Null counts as empty, an empty text is one line of spaces.  Each row is a member,
    repeated or not; an empty table makes a listing without archives.
    """
    register(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [padded(text.as_py()) for text in batch.column(1)]
            columns = [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_png(p) for _, p in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    made = rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")
    made.write.format("media_archive").mode("append").save(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Members of all listed archives; ``error`` says what is wrong with those that stayed damaged (media null)."""
    register(spark)
    return spark.read.format("media_archive").load(folder)


FEATURES = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def features(members: DataFrame) -> DataFrame:
    """What the samples read back say; a row without media has nulls, its doc_id and n_bytes."""

    def describe(doc_id, n_bytes, media):
        if media is None:
            return doc_id, n_bytes, None, None, None, None, None, None
        samples = from_png(media)
        payload = samples.tobytes()
        tall, wide = samples.shape
        shares = np.bincount(samples.ravel() >> 5, minlength=8) / samples.size
        steps = float(np.abs(np.diff(samples.astype(np.int16), axis=1)).mean())
        feature = f"{wide}x{tall} mean {samples.mean():.4f} step {steps:.4f} levels " + " ".join(f"{s:.4f}" for s in shares)
        digest = hashlib.sha256(payload).hexdigest()
        return doc_id, n_bytes, len(payload), digest, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in FEATURES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            if batch.num_rows:
                rows = [describe(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return members.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store all texts in a fresh folder of archives, read them back, compute features; see :func:`store`.

    A member that stays damaged fails the job: nothing was lost on the way.
    """
    folder = new_run_dir(docs.sparkSession, "media")
    store(docs, folder)
    members = load(docs.sparkSession, folder)
    whole = F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "error")))
    return features(members.withColumn("media", whole))
