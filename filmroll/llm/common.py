"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expressions of the white space and of the words between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch at most, where the session allows more.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table; Arrow batches are kept small, as a text may be long."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= ARROW_ROWS:
        spark.conf.set(limit, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def batches_of(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Jobs that run inside take Arrow batches of about ``n_bytes``, for tables whose rows are large."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, n_bytes)
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a session of one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        where = tempfile.mkdtemp(prefix="filmroll-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers up to which a counted table is sent to every executor (some 20 MB).
BROADCAST_ROWS = 500_000


def sized_hint(stored: DataFrame) -> DataFrame:
    """A stored table of a few narrow columns, to be broadcast if it is counted small, else merged by sorting."""
    return stored.hint("broadcast" if stored.count() <= BROADCAST_ROWS else "merge")


def set_aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns of ``docs`` and all others in one struct ``rest``, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def put_back(df: DataFrame, columns: list[str]) -> list[Column]:
    """The original ``columns`` of a frame from :func:`set_aside`; those still there as they are now."""
    return [F.col(c) if c in df.columns and c != "rest" else F.col("rest").getField(c).alias(c) for c in columns]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public murmur3 one), elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 17


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte value a random word (A-Z as a-z), and the powers of an odd base with their inverses."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    values[65:91] = values[97:123]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, _BASE)]), dtype=np.uint64)
    inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK, inverse)]), dtype=np.uint64)
    return values, powers, inverses


_CACHE: dict[str, tuple] = {}
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_sums(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and sum (values of its bytes times powers from its start) of every word in a block."""
    if "tables" not in _CACHE:
        _CACHE["tables"] = _tables()
    values, powers, inverses = _CACHE["tables"]
    space = _IS_SPACE[block]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[block] * powers[: len(block)], dtype=np.uint64)])
    return start, (end - start).astype(np.uint64), (sums[end] - sums[start]) * inverses[start]


def word_hashes(text: bytes) -> np.ndarray:
    """uint64 hash of each white-space separated word of UTF-8 ``text``, A-Z taken as a-z.

    Works through the text in blocks, so memory follows the block and the number
    of words; the sum and size of a word that a block leaves open go on in the
    next one, so words may have any length.
    """
    data, found = np.frombuffer(text, dtype=np.uint8), []
    open_sum, open_size = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for at in range(0, len(data), _BLOCK):
        block = data[at : at + _BLOCK]
        start, size, total = _word_sums(block)
        if open_size[0]:
            if len(start) and start[0] == 0:
                total[:1] = open_sum + total[:1] * np.uint64(pow(int(_BASE), int(open_size[0]), 1 << 64))
                size[:1] += open_size
            else:
                found.append(mix64(open_sum + open_size))
            open_size = np.zeros(1, np.uint64)
        if at + len(block) < len(data) and not _IS_SPACE[block[-1]]:
            open_sum, open_size, total, size = total[-1:], size[-1:], total[:-1], size[:-1]
        found.append(mix64(total + size))
    if open_size[0]:
        found.append(mix64(open_sum + open_size))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct uint64 hashes of the ``size``-word shingles; a shorter text counts as one; no words: none."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        total = total + words[k : k + n] * np.uint64(pow(int(_BASE), k, 1 << 64))
    return np.unique(mix64(total + np.uint64(min(size, len(words)))))


def slices(n_bytes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose bytes sum to about ``most``; a larger row stands alone."""
    at = 0
    ends = np.cumsum(n_bytes)
    while at < len(n_bytes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, stop
        at = stop
