"""Operator 13, compression of vectors to product codes through tries of their parts.

A vector is cut into 16 equal parts and each part becomes the index of the
nearest of 64 entries. The parts of a block of rows are reduced to distinct ones
with weights, in lexicographic order; that order is a trie, each dimension a
level. A depth-first walk carries the distances of a prefix to all entries, so
parts that begin alike share them; a leaf takes the nearest entry, and adds its
parts to that entry by weight. Rows are read where they are, three times, and
only sums of entries move.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmroll.llm.common import BROADCAST_ROWS, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block of rows, whose parts make one trie for each position.
BLOCK_VALUES = 1 << 21
#: Leaves below which a subtree is walked level by level in one piece.
LEAVES = 4_096
#: Parts that a sum of a label is dealt out to, where there are too many labels to broadcast.
SALTS = 64


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64 where squares of differences stay far within 64 bits, else Python integers."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() < 1 << 15:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [int(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE) for x in values.tolist()]
    return np.array([*exact, None], dtype=object)[:-1]


def _changes(parts: np.ndarray, depth: int) -> np.ndarray:
    """Where, in sorted rows, the value of column ``depth`` differs from the row before."""
    return np.concatenate([[True], parts[1:, depth] != parts[:-1, depth]])


def walk_trie(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and squared distance of each of the distinct, sorted ``parts``.

    Depth-first: a node hands its distances to its children. Subtrees of up to
    ``LEAVES`` leaves go level by level, so that numpy has rows to work on.
    """
    width = parts.shape[1]
    codes = np.zeros(len(parts), dtype=np.int64)
    dists = np.zeros(len(parts), dtype=parts.dtype)
    stack = [(0, len(parts), 0, np.zeros((1, len(entries)), dtype=parts.dtype))] if len(parts) else []
    while stack:
        lo, hi, depth, shared = stack.pop()
        rows = parts[lo:hi]
        if hi - lo > LEAVES and depth < width:
            starts = np.flatnonzero(_changes(rows, depth))
            carried = shared + (rows[starts, depth][:, None] - entries[:, depth]) ** 2
            ends = np.append(starts[1:], hi - lo)
            stack += [(lo + a, lo + b, depth + 1, carried[i : i + 1]) for i, (a, b) in reversed(list(enumerate(zip(starts, ends, strict=True))))]
            continue
        node, fresh = np.zeros(hi - lo, dtype=np.int64), np.zeros(hi - lo, dtype=bool)
        for d in range(depth, width):
            fresh |= _changes(rows, d)
            starts = np.flatnonzero(fresh)
            shared = shared[node[starts]] + (rows[starts, d][:, None] - entries[:, d]) ** 2
            node = np.cumsum(fresh) - 1
        best = np.argmin(shared, axis=1)
        codes[lo:hi], dists[lo:hi] = best[node], shared[np.arange(len(shared)), best][node]
    return codes, dists


def _tries(block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position: its distinct parts in lexicographic order, their weights, and each row's part."""
    n, width = len(block), block.shape[1] // PARTS
    for p in range(PARTS):
        own = block[:, p * width : (p + 1) * width]
        order = np.lexsort(own.T[::-1]) if width else np.arange(n)
        ranked = own[order]
        fresh = np.any(ranked[1:] != ranked[:-1], axis=1) if width else np.zeros(max(n - 1, 0), bool)
        fresh = np.concatenate([[True], fresh])[:n]
        which = np.empty(n, dtype=np.int64)
        which[order] = np.cumsum(fresh) - 1
        yield ranked[fresh], np.bincount(which), which


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in blocks of about BLOCK_VALUES components, with their whole-number vectors, filled up with zeros to 16 equal parts."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rows = _whole(flat).reshape(table.num_rows, length)
        gap = -length % PARTS
        return table, np.hstack([rows, np.zeros((table.num_rows, gap), dtype=rows.dtype)]) if gap else rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and sum(b.num_rows for b in held) * max(1, length) >= BLOCK_VALUES:
            yield block()
            held = []
    if held:
        yield block()


def _typed(block: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Both as int64, unless one of them holds larger numbers."""
    kind = np.int64 if block.dtype != object and all(b.dtype != object for b in books) else object
    return block.astype(kind), [b.astype(kind) for b in books]


SUMS = "p int, e int, n long, total array<string>"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Position, entry, count and sums of components."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["p", "e", "n", "total"])


def _learn(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round; sums come from the leaves of every block's tries and meet by position and entry."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, length):
            block, own = _typed(block, books)
            found = []
            for p, (parts, weights, _) in enumerate(_tries(block)):
                codes, _ = walk_trie(parts, own[p])
                total = np.zeros(own[p].shape, dtype=block.dtype)
                np.add.at(total, codes, parts * weights[:, None])
                count = np.bincount(codes, weights, len(own[p]))
                found += [(p, int(e), int(count[e]), [str(v) for v in total[e]]) for e in np.flatnonzero(count)]
            yield batch_of(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for p, e, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = found.setdefault((p, e), [0] * (width + 1))
                held[:] = [a + int(b) for a, b in zip(held, (n, *total), strict=True)]
        rows = [(*k, v[0], [str(x) for x in v[1:]]) for k, v in found.items()]
        yield batch_of(rows)

    partial = rows.select("vector").mapInArrow(sums, SUMS).repartition("p", "e")  # sums may pass 64 bits, so they travel as texts
    learnt = [b.astype(object) for b in books]
    for row in partial.mapInArrow(add, SUMS).collect():
        learnt[row["p"]][row["e"]] = [int(x) // row["n"] for x in row["total"]]
    small = all(abs(int(x)) < 1 << 23 for b in learnt for x in b.flat)
    return [b.astype(np.int64) for b in learnt] if small else learnt


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Product codes of vectors, with errors and the digest of the codebooks.

    ``key``, code (two hex digits for each part), error, label_error and
    codebooks_sha256, a row for each row kept. Rows whose vector is null or holds
    a null or non-finite component are dropped, and so are those of another
    length than the first vector kept has (that of the least key; nulls last,
    ties by vector). Lengths that 16 does not divide are filled up with zeros.
    Fewer than 64 rows make fewer entries; repeated rows are rows; an empty table
    gives no rows. Errors that pass 64 bits are null. Other columns are not
    looked at, whatever their names.
    """
    spark, finite = vectors.sparkSession, F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label")).where(F.col("vector").isNotNull() & finite)
    ordered = [F.col("key").asc_nulls_last(), F.col("vector")]
    kind = T.StructType([rows.schema["key"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), rows.schema["label"]])
    first = rows.orderBy(*ordered).select(F.size("vector").alias("n")).first()
    length = first["n"] if first else 0
    rows = rows.where(F.size("vector") == length)
    chosen = [r["vector"] for r in rows.orderBy(*ordered).select("vector").limit(ENTRIES).collect()]
    width = -(-length // PARTS)
    start = _whole(np.array(chosen, dtype=np.float64).reshape(-1)).reshape(len(chosen), length)
    start = np.hstack([start, np.zeros((len(chosen), width * PARTS - length), dtype=start.dtype)])
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]
    for _ in range(ROUNDS if chosen and length else 0):
        books = _learn(rows, books, length)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, block in _blocks(batches, length):
            block, own = _typed(block, books)
            code, error = np.empty((len(block), PARTS), dtype=np.uint8), np.zeros(len(block), dtype=block.dtype)
            for p, (parts, _, which) in enumerate(_tries(block)):
                codes, dists = walk_trie(parts, own[p])
                code[:, p], error = codes[which], error + dists[which]
            raw = code.tobytes().hex()
            texts = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
            errors = [e if -(1 << 63) <= e < 1 << 63 else None for e in map(int, error)]
            out = pa.table({"key": table.column("key"), "code": pa.array(texts, pa.string()), "error": pa.array(errors, pa.int64()), "label": table.column("label")})
            yield from out.combine_chunks().to_batches()

    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()
    coded = materialize(rows.mapInArrow(encode, kind))
    sums = materialize(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= BROADCAST_ROWS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("same")), "left")
    else:
        dealt = sums.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("deal")), "left")
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings``."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same by plain SQL: every part against every entry, two rounds, then codes and digests."""
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p))""",
        f"""book0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id)) - 1 AS e, x AS c FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))""",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((({distance})::BIGINT, e)) AS best FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p)")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (SELECT p, e, list(m ORDER BY i) AS m FROM (SELECT p, best[2] AS e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m
                FROM near{r}, range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY p, e)""")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.m, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)")
    last = ROUNDS
    return f"""WITH {", ".join(steps)},
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{last} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


SQL = _sql()

QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE_SQL = {"op13_vector_codes": SQL}
