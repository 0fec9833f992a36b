"""Many query vectors at once, through an inverted file of vector cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.operators.vectors import _unit
from filmroll.sources.staging import staged

#: Vectors that the cells are fitted on, and cells at most (a matrix of so many rows goes to every executor).
TRAIN_ROWS, MAX_CELLS = 16_384, 1_024
#: Vectors of a block of a cell, and queries that meet it at once.
BLOCK_ROWS, PACK_ROWS = 2_048, 512
ROUNDS = 8
#: The cell of vectors of length 0, whose similarity to everything is 0.
NULL_CELL = -1
#: What a bound allows for rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """Per cell its unit centre and the angles of the nearest and farthest vector in it."""

    dim: int
    cells: np.ndarray
    centres: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest similarity that each query (a unit vector) can have in each cell.

        Angles obey the triangle inequality: a vector is at least as far from
        the query as the query is from the cell's ring of angles.
        """
        angle = np.arccos(np.clip(queries @ self.centres.T, -1, 1))
        apart = np.maximum(0, np.maximum(angle - self.outer, self.inner - angle))
        known = np.linalg.norm(queries, axis=1) > 0
        bound = np.where(known[:, None], np.cos(np.minimum(apart, np.pi)), 0.0)
        return np.where(self.cells == NULL_CELL, 0.0, bound) + SLACK


@dataclass(frozen=True)
class VectorIndex:
    """``blocks`` (cell, block, ids, data) of vectors of one dimension, and their cells."""

    blocks: DataFrame
    map: Cells


def _fit(sample: np.ndarray, n_cells: int) -> np.ndarray:
    """Unit centres of the sample by spherical k-means; a centre without vectors stays."""
    centres = sample[np.linspace(0, len(sample) - 1, n_cells).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = _unit(sums)
        centres = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, centres)
    return centres


def build_index(vectors: DataFrame, dim: int, n_cells: int | None = None) -> VectorIndex:
    """V1. An index of all ``vectors`` (vec_id, embedding) of ``dim`` components; null ones and those of other lengths are left out.

    Cells are fitted on at most TRAIN_ROWS vectors, by a hash of vec_id; every
    vector is indexed. A cell of many vectors is dealt into blocks. Without
    ``n_cells`` there are as many as the root of the number of vectors, up to MAX_CELLS.
    """
    known = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull())))
    count = known.count()
    sample = _unit([r["embedding"] for r in known.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(TRAIN_ROWS).collect()] or [[0.0] * dim])
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    wanted = min(MAX_CELLS, n_cells or max(1, int(count**0.5)), max(1, len(sample)))
    centres = _fit(sample, wanted) if len(sample) else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            unit = _unit(flat) if len(flat) else flat
            sims = unit @ centres.T
            cell = np.where(np.linalg.norm(unit, axis=1) > 0, np.argmax(sims, axis=1), NULL_CELL) if len(flat) else np.empty(0, int)
            angle = np.arccos(np.clip(sims[np.arange(len(unit)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["vec_id", "embedding", "cell", "angle"])

    placed = staged(known.mapInArrow(assign, "vec_id long, embedding array<float>, cell int, angle double"))
    rings = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer")).orderBy("cell").collect()  # MAX_CELLS + 1 at most
    blocks_of = F.create_map(*[x for r in rings for x in (F.lit(r["cell"]), F.lit(-(-r["n"] // BLOCK_ROWS)))]) if rings else F.create_map(F.lit(0), F.lit(1))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks_of, F.col("cell"))).cast("int"))
    blocks = staged(dealt.groupBy("cell", "block").agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("data")))
    cells = np.array([r["cell"] for r in rings], dtype=np.int64)
    return VectorIndex(blocks, Cells(dim, cells, centres[np.maximum(cells, 0)].reshape(len(cells), dim), *(np.array([r[c] for r in rings], dtype=np.float64) for c in ("inner", "outer"))))


PROBE = "query_id long, embedding array<double>, cell int, at double"
HIT = "query_id long, vec_id long, sim double"


def _open(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every block of the cells that queries (query_id, embedding, cell) ask for.

    Queries of a cell are dealt into packs, and a pack and a block make one
    row; each leaves k rows a query at most, whatever the block holds.
    """
    sizes = probes.groupBy("cell").agg(F.ceil(F.count("*") / PACK_ROWS).alias("packs"))
    dealt = probes.join(sizes, "cell").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.col("packs")))
    packs = dealt.groupBy("cell", "pack").agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("embedding")).alias("queries"))
    dim = index.map.dim

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, asked, queries in zip(*(batch.column(c) for c in ("ids", "data", "asked", "queries")), strict=True):
                ids, asked = ids.values.to_numpy(), asked.values.to_numpy()
                own = _unit(data.values.to_numpy().reshape(len(ids), dim))
                sims = queries.values.to_numpy().reshape(len(asked), dim) @ own.T
                order = np.argsort(ids)
                best = order[np.argsort(-sims[:, order], axis=1, kind="stable")[:, :k]]  # equal ones by vec_id
                rows = np.repeat(np.arange(len(asked)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(ids[best.ravel()]), pa.array(sims[rows, best.ravel()])], names=["query_id", "vec_id", "sim"])

    return packs.join(index.blocks.hint("merge"), "cell").select("ids", "data", "asked", "queries").mapInArrow(meet, HIT)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def batch_search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """V1. query_id, vec_id, sim and rank of the ``k`` most similar vectors of every query (query_id, embedding); ties by vec_id.

    Each query opens its ``probes`` most promising cells. ``exact`` then
    opens every other cell whose bound reaches the similarity of the k-th hit so
    far, so nothing is missed; without it the hits are those of the first cells.
    Queries that are null or of another dimension have no hits.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    cells = index.map
    asked = asked.where((F.size("embedding") == cells.dim) & F.forall("embedding", lambda x: x.isNotNull()))
    if not len(cells.cells):
        return _top(queries.sparkSession.createDataFrame([], HIT), k)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each query, best bound first: the first ones, or the others that reach ``floor``."""
        for batch in batches:
            later = "floor" in batch.schema.names
            for part in (batch.slice(i, 1_024) for i in range(0, batch.num_rows, 1_024)):
                unit = part.column("embedding").flatten().to_numpy().reshape(part.num_rows, cells.dim)
                unit = _unit(unit)
                bound = cells.bounds(unit)
                place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                take = (place >= probes) & (bound >= part.column("floor").to_numpy()[:, None]) if later else place < probes
                row, cell = np.nonzero(take)
                data = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32) * cells.dim, pa.array(unit[row].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), data, pa.array(cells.cells[cell], pa.int32()), pa.array(bound[row, cell])], names=[f.split()[0] for f in PROBE.split(", ")])

    first = staged(_top(_open(index, staged(asked.mapInArrow(choose, PROBE)), k), k))
    if not exact:
        return first
    floor = first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("sim"))).alias("floor"))
    left = asked.join(floor.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    more = _open(index, staged(left.mapInArrow(choose, PROBE)), k)
    return _top(first.select("query_id", "vec_id", "sim").union(more), k)


def write_index(index: VectorIndex, root: str) -> None:
    """V1. Keep an index as two tables, its blocks partitioned by cell."""
    spark, cells = index.blocks.sparkSession, index.map
    rows = [(int(c), *map(float, (a, b)), [float(x) for x in v]) for c, a, b, v in zip(cells.cells, cells.inner, cells.outer, cells.centres, strict=True)]
    spark.createDataFrame(rows, "cell int, inner double, outer double, centre array<double>").write.parquet(f"{root}/cells")
    index.blocks.write.partitionBy("cell").parquet(f"{root}/blocks")


def read_index(spark: SparkSession, root: str, dim: int) -> VectorIndex:
    """V1. An index as it was written; MAX_CELLS + 1 rows of cells at most come to the driver."""
    rows = spark.read.parquet(f"{root}/cells").orderBy("cell").collect()
    blocks = spark.read.schema("block int, ids array<long>, data array<float>, cell int").parquet(f"{root}/blocks")
    return VectorIndex(blocks, Cells(dim, np.array([r["cell"] for r in rows], dtype=np.int64), np.array([r["centre"] for r in rows]).reshape(len(rows), dim), *(np.array([r[c] for r in rows], dtype=np.float64) for c in ("inner", "outer"))))
