"""Every text file of a directory tree, in batch and as a stream.

Spark's own file sources pass over files and folders whose names begin with ``_`` or
``.``. This data source lists the tree itself, so ``_notes.md``, ``.hidden.txt`` and
``_drafts/b.txt`` are files like any other. It reads any store that Arrow's file
systems know (a local path, ``hdfs://``, ``s3://``, ``gs://``).

Batch: the tree is listed once and dealt into partitions of at most ``partitionBytes``
(a larger file is one of its own), which executors open and read.

Stream: offsets are numbers of a log under ``logLocation``, on shared storage. An entry
names the files that a micro-batch reads, found by comparing a listing with all entries
so far by path, time and length, so a file that is changed comes again and one that
appears with an old time is not missed. An entry is written under another name and
moved, before Spark learns its number: after a restart the same number names the same
files, and what was logged but never run is run. The driver keeps one 16-byte digest for
each file it has seen.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Readers travel with the job, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "text_tree"
EXTENSIONS = (".txt", ".md")
SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PARTITION_BYTES = 64 << 20
OPEN_BYTES = 1 << 20            # what opening a file counts as
BATCH_BYTES = 8 << 20


def open_tree(root: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """File system, path in it, and the prefix that makes such a path a URI."""
    if "://" not in root:
        root = root.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), root.rstrip("/") or "/", "file:"
    system, path = arrow_fs.FileSystem.from_uri(root)
    if root.startswith("file://"):
        return system, path.rstrip("/") or "/", "file:"
    scheme, rest = root.split("://", 1)
    bare = rest.split("?", 1)[0].rstrip("/")
    kept = path.rstrip("/")
    return system, kept, f"{scheme}://{bare.removesuffix(kept)}"


@dataclass(frozen=True)
class TextFile:
    path: str
    time: int       # microseconds since 1970
    length: int

    @property
    def digest(self) -> bytes:
        return hashlib.blake2b(json.dumps([self.path, self.time, self.length]).encode(), digest_size=16).digest()


def list_files(root: str, skip_hidden: bool = False) -> list[TextFile]:
    """Text files at any depth under ``root``, in order of path."""
    system, path, _ = open_tree(root)
    found = []
    for info in system.get_file_info(arrow_fs.FileSelector(path, recursive=True)):
        below = info.path.removeprefix(path).strip("/")
        if info.type != arrow_fs.FileType.File or not info.path.lower().endswith(EXTENSIONS):
            continue
        if skip_hidden and any(part.startswith((".", "_")) for part in below.split("/")):
            continue
        found.append(TextFile(info.path, (info.mtime_ns or 0) // 1000, info.size))
    return sorted(found, key=lambda f: f.path)


@dataclass
class Files(InputPartition):
    files: tuple[TextFile, ...]


def dealt(files: list[TextFile], limit: int) -> list[Files]:
    """Files in partitions of about ``limit`` bytes."""
    out, now, size = [], [], 0
    for f in files:
        cost = f.length + OPEN_BYTES
        if now and size + cost > limit:
            out.append(Files(tuple(now)))
            now, size = [], 0
        now.append(f)
        size += cost
    return [*out, Files(tuple(now))]


def read_files(root: str, files: tuple[TextFile, ...]) -> Iterator[pa.RecordBatch]:
    system, _, prefix = open_tree(root)
    kind = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")),
                      ("length", pa.int64()), ("content", pa.binary())])
    rows, size = [], 0
    for f in files:
        with system.open_input_stream(f.path) as stream:
            content = stream.read()
        rows.append((prefix + f.path, f.time, len(content), content))
        size += len(content)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.skip_hidden = options.get("skipHidden", "false").lower() == "true"
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        return dealt(list_files(self.root, self.skip_hidden), self.limit)

    def read(self, partition):
        return read_files(self.root, partition.files)


class TreeStreamReader(TreeReader, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.log = options["logLocation"]
        self.most = int(options.get("maxFilesPerTrigger", 0))
        self.seen: set[bytes] = set()
        self.last = 0               # entries that ``seen`` covers

    def _entry(self, number: int) -> str:
        return f"{open_tree(self.log)[1]}/{number:09d}.json"

    def _logged(self, number: int) -> list[TextFile]:
        with open_tree(self.log)[0].open_input_stream(self._entry(number)) as stream:
            return [TextFile(*f) for f in json.loads(stream.read())]

    def _catch_up(self) -> None:
        """Learn the entries that were written before this reader began."""
        system, folder, _ = open_tree(self.log)
        system.create_dir(folder, recursive=True)
        while system.get_file_info(self._entry(self.last + 1)).type == arrow_fs.FileType.File:
            self.last += 1
            self.seen.update(f.digest for f in self._logged(self.last))

    def initialOffset(self):
        return {"entry": 0}

    def latestOffset(self):
        self._catch_up()
        fresh = [f for f in list_files(self.root, self.skip_hidden) if f.digest not in self.seen]
        fresh.sort(key=lambda f: (f.time, f.path))
        fresh = fresh[:self.most] if self.most else fresh
        if fresh:
            system, folder, _ = open_tree(self.log)
            name = f"{folder}/.writing-{self.last + 1:09d}"
            with system.open_output_stream(name) as out:
                out.write(json.dumps([[f.path, f.time, f.length] for f in fresh]).encode())
            system.move(name, self._entry(self.last + 1))
            self._catch_up()
        return {"entry": self.last}

    def partitions(self, start, end):
        files = [f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self._logged(n)]
        return dealt(files, self.limit)

    def commit(self, end):
        pass


class TextTree(DataSource):
    """``spark.read.format("text_tree")``; options ``path``, ``skipHidden``, ``partitionBytes``
    and, for a stream, ``logLocation`` and ``maxFilesPerTrigger`` (0: no limit)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextTree)
