"""An object store as a Spark data source: key ranges are listed in parallel, objects are put by tasks.

A store is a tree of files that every executor reaches, on any file system that pyarrow
knows.  An object's key is its path below the root; parts of a key that no file can be called
(``.``, ``..``, nothing) are spelled with ``%``, as is ``%`` itself.  What a file system cannot hold is
an object whose key, with a ``/`` behind it, begins another's.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    StringStartsWith,
    WriterCommitMessage,
)

PAGE = 1000  # keys of a listing page
BATCH_BYTES = 4 << 20
RANGES, PROBES = 64, 4096
LISTED = "name string, size bigint, modified timestamp"
STAGED = ".staged"


def _spelled(part: str, folder: bool = False) -> str:
    """A file name for a part of a key; an empty folder's differs from that of an empty last part."""
    if folder and not part:
        return "%_"
    if part in ("", ".", "..", STAGED):
        return "%" + part.replace(".", "%2E")
    return part.replace("%", "%25").replace("\0", "%00")


def _read(name: str) -> str:
    return re.sub("%([0-9A-F]{2}|_)?", lambda m: "" if m[1] in (None, "_") else chr(int(m[1], 16)), name)


@dataclass
class Entry:
    key: str
    size: int
    modified: object


class Store:
    """Objects below a root, listed in the order of their keys (that of UTF-8 bytes, as of code points)."""

    def __init__(self, root: str):
        self._files, folder = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root))
        self._root = folder.rstrip("/")
        self._made: set[str] = set()

    def path(self, key: str) -> str:
        *folders, last = key.split("/")
        return "/".join([self._root, *[_spelled(part, folder=True) for part in folders], _spelled(last)])

    def _names(self, folder: str) -> Iterator[tuple[str, bool, fs.FileInfo | None]]:
        """Its entries by key, in no order, whether they are folders, and what is known of them; a folder's key ends in ``/``.

        One call of the file system; a local one hands over names one by one, and nothing else.
        """
        place = self.path(folder).rpartition("/")[0]
        found: Iterator[tuple[str, bool, fs.FileInfo | None]]
        if isinstance(self._files, fs.LocalFileSystem):
            try:
                found = ((x.name, x.is_dir(), None) for x in os.scandir(place))
            except FileNotFoundError:
                return
        else:
            infos = self._files.get_file_info(fs.FileSelector(place, allow_not_found=True))
            found = ((x.base_name, x.type == fs.FileType.Directory, x) for x in infos)
        for name, is_folder, info in found:
            if folder or name != STAGED:
                yield folder + (_read(name) if "%" in name else name) + "/" * is_folder, is_folder, info

    def _within(self, folder: str, after: str, upto: str | None) -> Iterator[tuple[str, bool, fs.FileInfo | None]]:
        """Entries with keys from ``after`` on and below ``upto``, and folders that may hold such, in order: no others are held."""
        found = (x for x in self._names(folder) if (x[0] >= after or x[1] and after.startswith(x[0])) and (upto is None or x[0] < upto))
        return iter(sorted(found, key=lambda x: x[0]))

    def _keys(self, after: str, upto: str | None, folder: str = "") -> Iterator[tuple[str, fs.FileInfo | None]]:
        for key, is_folder, info in self._within(folder, after, upto):
            if is_folder:
                yield from self._keys(after, upto, key)
            else:
                yield key, info

    def entries(self, after: str = "", upto: str | None = None) -> Iterator[Entry]:
        """Objects with keys from ``after`` on and below ``upto``, in order; folders without any are not looked into."""
        for key, info in self._keys(after, upto):
            info = info or self._files.get_file_info(self.path(key))
            yield Entry(key, info.size, info.mtime)

    def first(self, after: str) -> str | None:
        return next((key for key, _ in self._keys(after, None)), None)

    def read(self, key: str) -> bytes:
        with self._files.open_input_stream(self.path(key)) as stream:
            return stream.read()

    def stage(self, folder: str, number: int, content: bytes) -> str:
        name = f"{STAGED}/{folder}/{number}"
        if number == 0:
            self._files.create_dir(f"{self._root}/{STAGED}/{folder}", recursive=True)
        with self._files.open_output_stream(f"{self._root}/{name}") as stream:
            stream.write(content)
        return name

    def unstage(self, folder: str) -> None:
        self._files.delete_dir_contents(f"{self._root}/{STAGED}/{folder}", missing_dir_ok=True)

    def publish(self, staged: str, key: str) -> None:
        """Move staged bytes to their key, in place of what is there; where that is done already, nothing happens."""
        place, target = f"{self._root}/{staged}", self.path(key)
        folder = target.rpartition("/")[0]
        if folder not in self._made:
            self._files.create_dir(folder, recursive=True)
            self._made.add(folder)
        try:
            self._files.move(place, target)
        except OSError:
            if self._files.get_file_info(place).type != fs.FileType.NotFound:
                raise
            if self._files.get_file_info(target).type == fs.FileType.NotFound:
                raise FileNotFoundError(f"neither staged nor published: {key}") from None


class Outline(Store):
    """A store as the driver sees it that plans its ranges: of each folder, some thousand keys with the prefix at most.

    Each folder is gone through once, and those whose keys have the least checksums are held.
    """

    def __init__(self, root: str, prefix: str = "", most: int = PROBES):
        super().__init__(root)
        self._prefix, self._most = prefix, most
        self._seen: dict[str, list[tuple[str, bool, None]]] = {}

    def _within(self, folder: str, after: str, upto: str | None) -> Iterator[tuple[str, bool, fs.FileInfo | None]]:
        if folder not in self._seen:
            below = ((key, is_folder, None) for key, is_folder, _ in self._names(folder) if key.startswith(self._prefix) or is_folder and self._prefix.startswith(key))
            least = heapq.nsmallest(self._most, below, key=lambda x: zlib.crc32(x[0].encode("utf-8", "surrogateescape")))
            if sum(map(len, self._seen.values())) > 16 * self._most:
                self._seen.clear()
            self._seen[folder] = sorted(least)
        entries = self._seen[folder]
        # the folder that holds ``after`` sorts before it
        start = max(0, bisect.bisect_left(entries, after, key=lambda x: x[0]) - 1)
        for key, is_folder, info in itertools.islice(entries, start, None):
            if upto is not None and key >= upto:
                return
            if key >= after or is_folder and after.startswith(key):
                yield key, is_folder, info


# --- listing -------------------------------------------------------------------


def after_all(prefix: str) -> str | None:
    """The first key behind all that begin with ``prefix``."""
    for at in range(len(prefix) - 1, -1, -1):
        if prefix[at] != chr(0x10FFFF):
            code = ord(prefix[at]) + 1
            return prefix[:at] + chr(0xE000 if code == 0xD800 else code)
    return None


def branches(store: Store, prefix: str, probes: int) -> list[str]:
    """``prefix`` with each character that goes on some key, found by asking for the first key from a place on."""
    found: list[str] = []
    place: str | None = prefix + "\0"
    while place is not None and len(found) < probes:
        key = store.first(place)
        if key is None or not key.startswith(prefix):
            break
        found.append(key[: len(prefix) + 1])
        place = after_all(found[-1])
    return found


def cuts(store: Store, prefix: str, ranges: int = RANGES, probes: int = PROBES) -> list[str]:
    """Where to cut the keys with a prefix into ranges: at the branches of their tree, level by level.

    The driver asks ``probes`` times at most for the first key from a place on, of an :class:`Outline`.
    As each range goes through the names of the folders it is in, there are no more than ``ranges``.
    """
    level = [prefix]
    while len(level) < ranges and probes > 0:
        below = []
        for branch in level:
            found = branches(store, branch, probes) if probes > 0 else []
            probes -= len(found) + 1
            below += [branch, *found] if found and store.first(branch) == branch else found or [branch]
        if below == level:
            break
        level = below
    found = sorted(set(level) - {prefix})
    return found[:: max(1, -(-len(found) // ranges))]


@dataclass
class KeyRange(InputPartition):
    after: str
    upto: str | None


class ListingReader(DataSourceReader):
    """Plans key ranges; takes conditions on names from the query as the range to list."""

    def __init__(self, options):
        self.root = options["path"]
        self.ranges = int(options.get("ranges", RANGES))
        self.content = options.get("content", "false").lower() == "true"
        self.prefix, self.after, self.upto = "", "", None

    def _narrow(self, after: str, upto: str | None) -> None:
        self.after = max(self.after, after)
        if upto is not None:
            self.upto = upto if self.upto is None else min(self.upto, upto)

    def pushFilters(self, filters: list[Filter]):
        for condition in filters:
            if getattr(condition, "attribute", None) != ("name",):
                yield condition
            elif isinstance(condition, StringStartsWith):
                self._narrow(condition.value, after_all(condition.value))
                self.prefix = max(self.prefix, condition.value, key=len)
            elif isinstance(condition, EqualTo):
                self._narrow(condition.value, condition.value + "\0")
            elif isinstance(condition, GreaterThanOrEqual):
                self._narrow(condition.value, None)
            elif isinstance(condition, GreaterThan):
                self._narrow(condition.value + "\0", None)
            elif isinstance(condition, LessThan):
                self._narrow("", condition.value)
            elif not isinstance(condition, IsNotNull):
                yield condition

    def partitions(self) -> list[KeyRange]:
        at = [c for c in cuts(Outline(self.root, self.prefix), self.prefix, self.ranges) if c > self.after and (self.upto is None or c < self.upto)]
        return [KeyRange(a, b) for a, b in zip([self.after, *at], [*at, self.upto])]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        store = Store(self.root)
        page, held = [], 0
        for entry in store.entries(partition.after, partition.upto):
            row = [entry.key, entry.size, entry.modified]
            if self.content:
                row.append(store.read(entry.key))
                held += entry.size
            page.append(row)
            if len(page) >= PAGE or held >= BATCH_BYTES:
                yield self._batch(page)
                page, held = [], 0
        if page:
            yield self._batch(page)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC")] + [pa.binary()] * self.content
        names = ["name", "size", "modified"] + ["content"] * self.content
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


# --- putting -------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    objects: int


class PutWriter(DataSourceArrowWriter):
    """Tasks stage bytes beside a list of where they belong; the driver notes the lists of the tasks that count."""

    def __init__(self, options):
        self.root, self.run = options["path"], options["run"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, folder = Store(self.root), f"{self.run}/{uuid.uuid4().hex}"
        lists, objects = None, 0
        for batch in iterator:
            columns = batch.drop_columns(["content"])
            staged = []
            for content in batch.column("content"):
                staged.append(store.stage(folder, objects, content.as_py() or b""))
                objects += 1
            if not staged:
                continue
            columns = columns.append_column("staged", pa.array(staged, pa.string()))
            if lists is None:
                out = store._files.open_output_stream(f"{store._root}/{STAGED}/{folder}/list.parquet")
                lists = pq.ParquetWriter(out, columns.schema)
            lists.write_batch(columns)
        if lists is not None:
            lists.close()
            out.close()
        return Staged(folder, objects)

    def commit(self, messages: list[Staged | None]) -> None:
        store = Store(self.root)
        counted = [m.folder for m in messages if m and m.objects]
        store._files.create_dir(f"{store._root}/{STAGED}/{self.run}", recursive=True)
        with store._files.open_output_stream(f"{store._root}/{STAGED}/{self.run}/counted") as out:
            out.write("\n".join(counted).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        for message in messages:
            if message:
                Store(self.root).unstage(message.folder)


class ObjectStore(DataSource):
    """``spark.read.format("object_store").load(root)``; options ranges, content (bytes too).  Writing: see :func:`put_objects`."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def schema(self) -> str:
        return LISTED + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema):
        return ListingReader(self.options)

    def writer(self, schema, overwrite):
        return PutWriter(self.options)


def list_objects(spark: SparkSession, root: str, content: bool = False, ranges: int = RANGES) -> DataFrame:
    """Names, sizes and times (and bytes) of a store's objects, as they are when the query runs.

    Conditions on ``name`` (prefix, range, equality) narrow what is listed.  A task lists one key
    range, page by page.
    """
    spark.dataSource.register(ObjectStore)
    options = {"content": str(content).lower(), "ranges": str(ranges)}
    return spark.read.format("object_store").options(**options).load(root)


def put_objects(rows: DataFrame, root: str, key: str = "name") -> DataFrame:
    """Put ``content`` of each row at its ``key``; gives the other columns of what was put.

    Keys are unique; null content is an empty object.  Bytes are staged by one job, which counts
    once all its tasks are done: failed and repeated tasks leave nothing at any key.  A
    second job then moves them to their keys, which may run again any number of times.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ObjectStore)
    rows.write.format("object_store").mode("append").option("run", run).save(root)
    return publish(spark, root, run, key, rows.drop("content").schema)


def publish(spark: SparkSession, root: str, run: str, key: str, schema) -> DataFrame:
    """The second job of :func:`put_objects`: also finishes a run that was interrupted."""
    store = Store(root)
    with store._files.open_input_stream(f"{store._root}/{STAGED}/{run}/counted") as found:
        counted = found.read().decode().split()
    if not counted:
        return spark.createDataFrame([], schema)
    lists = [f"{root.rstrip('/')}/{STAGED}/{folder}/list.parquet" for folder in counted]
    staged = spark.read.parquet(*lists)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for place, name in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                store.publish(place, name)
            yield batch.slice(0, 0)

    moved = staged.select(F.col(key).alias("name"), "staged").mapInArrow(move, "name string, staged string")
    moved.write.format("noop").mode("overwrite").save()
    return staged.drop("staged")
