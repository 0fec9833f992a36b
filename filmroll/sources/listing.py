"""Listings of file trees as a data source: folders are dealt to the executors, and the driver never holds the files."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from filmroll.sources.files import EXTENSIONS, RAW_EXTENSIONS

#: Rows of an Arrow batch.
BATCH = 1_000
#: Bytes of a file that are hashed at once.
CHUNK = 1 << 20


class Folder(InputPartition):
    """A folder, with all below it or its own files only, and the times its files must lie between."""

    def __init__(self, path: str, deep: bool, after: float, upto: float) -> None:
        super().__init__(path)
        self.path, self.deep, self.after, self.upto = path, deep, after, upto


class _Listing:
    """What the batch and the stream reader share. Options: path, depth, include_raw, hash."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.depth = int(options.get("depth", 1))
        self.hashed = options.get("hash", "false").lower() == "true"
        raw = options.get("include_raw", "false").lower() == "true"
        self.endings = tuple(f".{e}" for e in EXTENSIONS + (RAW_EXTENSIONS if raw else ()))

    def folders(self, after: float, upto: float) -> list[Folder]:
        """A partition for each folder ``depth`` levels down, and one for the files of each folder above."""
        found, level = [], [self.root]
        for _ in range(self.depth):
            found += [Folder(path, False, after, upto) for path in level]
            level = sorted(e.path for path in level for e in _entries(path) if e.is_dir(follow_symlinks=False))
        return found + [Folder(path, True, after, upto) for path in level]

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, stat in self._files(folder):
            if folder.after < stat.st_mtime <= folder.upto:
                rows.append((path, stat.st_size, stat.st_mtime, _content_hash(path) if self.hashed else None))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _files(self, folder: Folder) -> Iterator[tuple[str, os.stat_result]]:
        todo = [folder.path]
        while todo:
            for e in _entries(todo.pop()):
                if e.is_dir(follow_symlinks=False):
                    todo += [e.path] if folder.deep else []
                elif e.name.lower().endswith(self.endings):
                    try:
                        yield e.path, e.stat()
                    except FileNotFoundError:  # gone since it was listed
                        continue


def _entries(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return list(found)
    except FileNotFoundError:
        return []


def _content_hash(path: str) -> int | None:
    """The hash that ``fingerprint`` gives; null if the file went away."""
    import xxhash

    digest = xxhash.xxh64(seed=42)
    try:
        with open(path, "rb") as file:
            while chunk := file.read(CHUNK):
                digest.update(chunk)
    except FileNotFoundError:
        return None
    return int.from_bytes(digest.digest(), "big", signed=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "size", "mtime", "hash"])


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders(float("-inf"), float("inf"))


class _StreamReader(_Listing, DataSourceStreamReader):
    """Offsets are times: a batch takes the files that were changed between two of them."""

    def initialOffset(self) -> dict:
        return {"upto": -1.0}

    def latestOffset(self) -> dict:
        return {"upto": time.time()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.folders(start["upto"], end["upto"])

    def commit(self, end: dict) -> None:
        pass


class FileListing(DataSource):
    """S1. ``spark.read`` and ``spark.readStream`` ``.format("media_files")``: path, size, mtime (seconds) and hash of the files under ``path``.

    For folders that every executor sees. A partition is a folder ``depth`` levels
    (1 unless given) under the root, so only these folders' names pass the driver. ``hash`` reads the
    contents, in pieces. The stream takes files by their time of change: one that is
    moved in with an old time is not seen, and one that is written while a batch reads
    comes in the next one.
    """

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "path string, size long, mtime double, hash long"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FileListing)
