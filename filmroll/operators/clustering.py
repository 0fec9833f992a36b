"""Clustering of vectors, names for clusters, and comparison of runs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import euclidean, normalize
from filmroll.operators.graph import components
from filmroll.operators.vectors import centroids
from filmroll.sources.staging import small, staged
from filmroll.sources.tables import union_all

#: Points of a block of the neighbour join, and dimensions of the grid it goes by.
CELL_POINTS, GRID_DIMS = 1_024, 3
#: Pairs of blocks in an Arrow batch.
PAIR_ROWS = 100
#: Dimensions up to which dense sub-cells are looked for; beyond, their sides are too short to hold many points.
SUB_DIMS = 6
#: Dense sub-cells up to which their keys are sent to every executor.
CELL_ROWS = 200_000
#: Columns of a point and of a dense sub-cell in a block.
POINT, SUB_CELL = ("node", "reduced", "w", "tied"), ("node", "reduced", "high", "tips")
#: Pairs of sub-cells whose outermost points are compared at once.
TIP_ROWS = 1_024


@contextmanager
def pair_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside take Arrow batches of PAIR_ROWS rows, as a row is a pair of blocks."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, PAIR_ROWS)
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def reduce_dims(vectors: DataFrame, n_components: int) -> DataFrame:
    """V7. vec_id and reduced: the first principal components of the unit vectors."""
    unit = vectors.select("vec_id", array_to_vector(normalize(F.col("embedding"))).alias("_v"))
    model = PCA(k=n_components, inputCol="_v", outputCol="_r").fit(unit)
    return model.transform(unit).select("vec_id", vector_to_array("_r").alias("reduced"))


def _cell(side: float) -> Column:
    return F.transform(F.slice("reduced", 1, GRID_DIMS), lambda x: F.floor(x / side))


def _around(cells: DataFrame) -> DataFrame:
    """Rows with each cell around theirs (cell), itself included, in ``at``."""
    around = F.col("cell")
    near = cells.withColumn("at", F.array().cast("array<bigint>"))
    for i in range(GRID_DIMS):
        near = near.withColumn("step", F.explode(F.when(F.size(around) > i, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        near = near.withColumn("at", F.when(F.size(around) > i, F.concat("at", F.array(F.try_add(F.get(around, F.lit(i)), F.col("step"))))).otherwise(F.col("at"))).drop("step")
    return near


def _blocks(nodes: DataFrame, side: float, fields: tuple[str, ...]) -> DataFrame:
    """Blocks of rows of one cell of the grid: cell, salt and the ``fields`` of its rows as points."""
    placed = nodes.withColumn("cell", _cell(side))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_POINTS).alias("n_salts"))
    salted = placed.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("node", "reduced"), F.col("n_salts")))
    return staged(salted.groupBy("cell", "salt").agg(F.collect_list(F.struct(*fields)).alias("points")))


def _block_pairs(nodes: DataFrame, eps: float, ordered: bool, others: DataFrame | None = None, fields: tuple[str, ...] = POINT) -> DataFrame:
    """Pairs of blocks that may hold points up to ``eps`` apart, of ``nodes`` alone or of ``nodes`` and ``others``: own, others.

    Cells of side eps over the first dimensions, each with its neighbours; a
    cell of many points is dealt into several blocks. ``ordered`` gives every
    pair of blocks of ``nodes`` once. Of ``others`` only the cells that ``nodes``
    meet are put into blocks, and equal rows of one node as one weighted point.
    """
    side = (eps or 1.0) * (1 + 1e-9)
    blocks = _blocks(nodes, side, fields)
    near = _around(blocks)
    if others is None:
        against = blocks
    else:
        met = staged(_around(blocks.select("cell").distinct()).select(F.col("at").alias("cell")).distinct())
        placed = others.withColumn("cell", _cell(side)).join(met.hint("broadcast" if small(met, CELL_ROWS) else "merge"), "cell", "left_semi")
        against = _blocks(placed.groupBy("node", "reduced", "tied").agg(F.sum("w").alias("w")), side, fields)
    pairs = near.join(against.select(F.col("cell").alias("at"), F.col("salt").alias("other_salt"), F.col("points").alias("others")).hint("merge"), "at")
    pairs = pairs.where(F.struct("cell", "salt") <= F.struct(F.col("at").alias("cell"), F.col("other_salt").alias("salt"))) if ordered else pairs
    return pairs.select(F.col("points").alias("own"), "others")


def _read(batch: pa.RecordBatch) -> Iterator[tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]]:
    """The fields of both blocks of each pair, one pair at a time; lists as rows of a matrix."""

    def field(values: pa.Array) -> np.ndarray:
        if pa.types.is_list(values.type):
            return values.flatten().to_numpy().reshape(len(values), -1)
        return values.to_numpy(zero_copy_only=False)

    for own, others in zip(batch.column("own"), batch.column("others"), strict=True):
        yield tuple(map(field, own.values.flatten())), tuple(map(field, others.values.flatten()))


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of two lists of points, from differences, so that those of equal points are 0."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Entries of a boolean matrix that join all rows and columns that its true entries join."""
    rows, columns, found = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), []
    for start in range(len(rows)):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            mine = np.flatnonzero(near[i] & columns)
            columns[mine] = False
            for j in mine.tolist():
                more = np.flatnonzero(near[:, j] & rows).tolist()
                rows[more] = False
                found += [(i, j), *((r, j) for r in more)]
                todo += more
    return found


def _span(squares: Column) -> Column:
    """Root of the sum of an array, added in order, as :func:`_close` does."""
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def dense_cells(points: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame] | None:
    """Sub-cells whose points are all up to ``eps`` apart and more than ``min_samples``, and ``points`` with rep, the least vec_id of theirs; None without such cells.

    A sub-cell has the side eps / sqrt(d), and the box of its points is measured.
    All its points are core and in one component, so it stands for them: its
    row has their box (reduced, high) and, in ``tips``, the outermost points of each
    dimension. Tied points are in none.
    """
    first = points.select(F.size("reduced").alias("d")).first()
    if not eps or first is None or not 0 < first.d <= SUB_DIMS:
        return None
    side = eps / np.sqrt(first.d) * (1 - 1e-9)
    placed = points.withColumn("sub", F.when(~F.col("tied"), F.transform("reduced", lambda x: F.floor(x / float(side)))))
    at = [F.get("reduced", F.lit(i)) for i in range(first.d)]
    tips = F.flatten(F.array(*[most("reduced", x) for x in at for most in (F.min_by, F.max_by)]))
    cells = placed.where("sub IS NOT NULL").groupBy("sub").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"), F.array(*map(F.min, at)).alias("reduced"), F.array(*map(F.max, at)).alias("high"), tips.alias("tips"))
    wide = _span(F.zip_with("high", "reduced", lambda h, x: (h - x) * (h - x)))
    cells = staged(cells.where((F.col("w") - 1 >= min_samples) & (wide <= eps)))
    if cells.isEmpty():
        return None
    found = cells.select("sub", F.col("node").alias("rep"))
    return cells, staged(placed.join(found.hint("broadcast" if small(found, CELL_ROWS) else "merge"), "sub", "left").drop("sub"))


def _cell_links(cells: DataFrame, points: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """Edges (src, dst) that join dense sub-cells as their points up to ``eps`` apart do, beside the known ``edges``.

    Boxes farther apart are out, and two outermost points up to eps apart link their
    sub-cells at once. A pair that is still open, and in two components of all
    that is linked by then, is settled by its points: those within eps of the
    other's box, in blocks.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, low_a, high_a, tips_a), (b, low_b, high_b, tips_b) in _read(batch):
                gap, d = np.zeros((len(a), len(b))), low_a.shape[1]
                for k in range(d):
                    gap += np.maximum(0, np.maximum(low_b[None, :, k] - high_a[:, None, k], low_a[:, None, k] - high_b[None, :, k])) ** 2
                i, j = np.nonzero(np.sqrt(gap) <= eps)
                for at in range(0, len(i), TIP_ROWS):
                    one, two = i[at : at + TIP_ROWS], j[at : at + TIP_ROWS]
                    p, q = tips_a.reshape(len(a), -1, d)[one], tips_b.reshape(len(b), -1, d)[two]
                    total = np.zeros((len(one), 2 * d, 2 * d))
                    for k in range(d):
                        total += (p[:, :, None, k] - q[:, None, :, k]) ** 2
                    sure = np.sqrt(total.min(axis=(1, 2))) <= eps
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[one], b[two])), pa.array(np.maximum(a[one], b[two])), pa.array(sure)], names=["src", "dst", "sure"])

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(_close(a, b) <= eps).any() for (a,), (b,) in _read(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(hits, pa.bool_())) for c in ("src", "dst")], names=["src", "dst"])

    near = staged(_block_pairs(cells, 2 * eps, True, fields=SUB_CELL).mapInArrow(met, "src long, dst long, sure boolean").where("src <> dst").distinct())
    sure = near.where("sure").select("src", "dst")
    roots = components(edges.select("src", "dst").union(sure).toDF("u", "v"))
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")).hint("merge")
    undecided = near.where("NOT sure").select("src", "dst").join(root("src"), "src", "left").join(root("dst"), "dst", "left")
    undecided = staged(undecided.where(F.coalesce("src_root", "src") != F.coalesce("dst_root", "dst")).select("src", "dst"))
    if undecided.isEmpty():
        return sure

    def facing(own: str, other: str) -> DataFrame:
        boxed = undecided.join(cells.select(F.col("node").alias(other), F.col("reduced").alias("low"), "high").hint("merge"), other)
        met = boxed.join(points.where("rep IS NOT NULL").select(F.col("rep").alias(own), F.col("vec_id").alias("node"), "reduced").hint("merge"), own)
        out = F.transform("reduced", lambda x, i: F.greatest(F.get("low", i) - x, x - F.get("high", i), F.lit(0.0)))
        rows = staged(met.where(_span(F.transform(out, lambda x: x * x)) <= eps).select("src", "dst", "node", "reduced"))
        sizes = rows.groupBy("src", "dst").agg(F.ceil(F.count("*") / CELL_POINTS).alias("n_salts"))
        dealt = rows.join(sizes.hint("merge"), ["src", "dst"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("n_salts")))
        return staged(dealt.groupBy("src", "dst", "salt").agg(F.collect_list(F.struct("reduced")).alias("points")).drop("salt"))

    pairs = facing("src", "dst").withColumnRenamed("points", "own").join(facing("dst", "src").withColumnRenamed("points", "others").hint("merge"), ["src", "dst"])
    return sure.union(staged(pairs.mapInArrow(touching, "src long, dst long").distinct()))


def density_cluster(points: DataFrame, min_size: int, min_samples: int, eps: float, constraints: tuple | None = None) -> DataFrame:
    """V8. vec_id and cluster_no (-1: noise) by cutting the mutual-reachability graph at ``eps``.

    DBSCAN* of Campello, Moulavi and Sander (2013): core distance is the distance
    to the min_samples-th neighbour; an edge weighs the largest of its length and
    both core distances; components of edges up to eps with min_size points are
    clusters, numbered by their least point. Below the cut only whether a core
    distance is up to eps counts, so neighbours are counted, and edges between
    core points are thinned to forests that join the same points. Equal vectors
    are one weighted point. ``constraints`` are must-link pairs (src, dst) and
    cannot-links as ``apply_constraints`` takes them; points that they name stay
    on their own, and all edges between such points are kept for them.
    """
    tied = F.lit(False)
    named = points
    if constraints:
        tables = [constraints[0], *(constraints[1] if isinstance(constraints[1], tuple) else constraints[1:])]
        ids = [t.select(F.col(c).cast("long").alias("vec_id")) for t in tables for c in ("src", "dst", "region_id") if c in t.columns]
        known = ids[0]
        for more in ids[1:]:
            known = known.union(more)
        named, tied = points.join(known.distinct().withColumn("_tied", F.lit(True)), "vec_id", "left"), F.coalesce("_tied", F.lit(False))
    named = staged(named.select("vec_id", "reduced", F.when(tied, F.col("vec_id")).otherwise(-1).alias("alone"), tied.alias("tied")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (node, a, _, _), (_, b, w, _) in _read(batch):
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array((_close(a, b) <= eps) @ w, pa.int64())], names=["node", "n"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (node, a, _, tied_a), (other, b, _, tied_b) in _read(batch):
                dist = _close(a, b)
                near = dist <= eps
                both = near & np.outer(tied_a, tied_b)
                at = np.array([*_forest(near & ~both), *np.argwhere(both).tolist()], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(other[at[:, 1]]), pa.array(dist[at[:, 0], at[:, 1]])], names=["src", "dst", "weight"])

    dense = dense_cells(named, eps, min_samples)
    named = dense[1] if dense else named.withColumn("rep", F.lit(None).cast("long"))
    held = named.where("rep IS NOT NULL").select(F.col("rep").alias("node"), "reduced", F.lit(1).cast("long").alias("w"), "tied")
    with pair_batches(points.sparkSession):
        loose = staged(named.where("rep IS NULL").groupBy("reduced", "alone", "tied", "rep").agg(F.min("vec_id").alias("node"), F.count("*").alias("w")))
        both = lambda own: own.select(*held.columns).union(held) if dense else None
        within = _block_pairs(loose, eps, False, both(loose)).mapInArrow(counted, "node long, n long")
        counts = within.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") - 1 >= min_samples)  # but the point itself
        core = staged(counts.select("node"))
        alone = staged(loose.join(core.hint("merge"), "node", "left_semi"))
        edges = _block_pairs(alone, eps, not dense, both(alone)).mapInArrow(linked, "src long, dst long, weight double").where("src <> dst")
        if constraints:
            from filmroll.operators.feedback import apply_constraints

            edges = apply_constraints(staged(edges), *constraints)
        edges = staged(edges.where(F.col("weight") <= eps).select("src", "dst").distinct())
        edges = edges.union(_cell_links(dense[0], named, edges, eps)) if dense else edges
        roots = staged(components(edges.toDF("u", "v")))
    found = roots.withColumnRenamed("node", "at").hint("broadcast" if small(roots, CELL_ROWS) else "merge")
    units = loose.join(core.withColumn("unit", F.col("node")).hint("merge"), "node", "left").select("reduced", "alone", F.col("node").alias("at"), "unit")
    apart = named.where("rep IS NULL").join(units.hint("merge"), ["reduced", "alone"]).select("vec_id", "at", "unit")
    placed = apart.union(named.where("rep IS NOT NULL").select("vec_id", "rep", "rep")).join(found, "at", "left")
    labelled = staged(placed.select("vec_id", F.coalesce("root", "unit", "vec_id").alias("root")))
    large = labelled.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    numbered = staged(large.select("root", (F.row_number().over(W.orderBy("root")) - 1).cast("int").alias("cluster_no")))
    return labelled.join(numbered.hint("broadcast" if small(numbered, CELL_ROWS) else "merge"), "root", "left").select("vec_id", F.coalesce("cluster_no", F.lit(-1)).alias("cluster_no"))


def level_grid(eps: float, levels: int) -> list[float]:
    """The distances of a hierarchy, each the square root of 2 times the one before, ``eps`` being the last."""
    return [eps * 2 ** (-(levels - 1 - i) / 2) for i in range(levels)]


def density_hierarchy(points: DataFrame, min_size: int, min_samples: int, eps: float, levels: int = 12) -> DataFrame:
    """V8. vec_id, cluster_no (-1: noise) and level of birth: the most stable clusters over a grid of cuts.

    HDBSCAN* (Campello, Moulavi and Sander, 2013) with the cuts of
    ``level_grid``: at each level the components of the mutual-reachability graph
    with ``min_size`` points and more. Towards smaller distances a component
    goes on as the same cluster while one such part of it is left; where there
    are several, they are new clusters. A cluster's stability is the sum, over the
    levels it lives, of its size times what 1 / distance gains there. Of clusters
    that lie in each other those with the largest sum are taken (excess of mass;
    the outer one on ties), a point being in a cluster it was in at its birth.

    Points meet once, in blocks of the grid of the largest distance: that leaves
    counts of neighbours by level, and a minimum spanning forest of each pair of
    blocks, by level. All levels' components are found in one go, on nodes
    numbered by point and level.
    """
    grid = np.array(level_grid(eps, levels))
    named = staged(points.select("vec_id", "reduced", F.lit(-1).alias("alone"), F.lit(False).alias("tied")))
    nodes = staged(named.groupBy("reduced", "alone", "tied").agg(F.min("vec_id").alias("node"), F.count("*").alias("w")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (node, a, _, _), (_, b, w, _) in _read(batch):
                at = np.searchsorted(grid, _close(a, b))
                n = np.stack([((at == i) @ w) for i in range(levels)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *(pa.array(n[:, i], pa.int64()) for i in range(levels))], names=["node", *(f"n{i}" for i in range(levels))])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (node, a, core_a, _), (other, b, core_b, _) in _read(batch):
                at = np.maximum(np.searchsorted(grid, _close(a, b)), np.maximum(core_a[:, None], core_b[None, :]))
                src, dst, level = [*zip(*_level_forest(at, node.tolist(), other.tolist(), levels), strict=True)] or ((),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(level, pa.int32())], names=["src", "dst", "level"])

    with pair_batches(points.sparkSession):
        within = _block_pairs(nodes, eps, ordered=False).mapInArrow(counted, "node long, " + ", ".join(f"n{i} long" for i in range(levels)))
        sums = within.groupBy("node").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(levels)])
        upto = F.lit(-1)  # but the point itself
        first = F.lit(None).cast("int")
        for i in range(levels):
            upto = upto + F.col(f"n{i}")
            first = F.coalesce(first, F.when(upto >= min_samples, F.lit(i)))
        core = staged(sums.select("node", first.alias("core")).where("core IS NOT NULL"))
        ranked = nodes.drop("w").join(core, "node").withColumnRenamed("core", "w")  # blocks carry core levels in place of weights
        edges = staged(_block_pairs(ranked, eps, ordered=True).mapInArrow(linked, "src long, dst long, level int").where("src <> dst").groupBy("src", "dst").agg(F.min("level").alias("level")))

    every = lambda least: F.explode(F.sequence(least, F.lit(levels - 1))).alias("l")
    at_level = lambda c: (F.col(c) * levels + F.col("l")).alias
    roots = components(edges.select("src", "dst", every(F.col("level"))).select(at_level("src")("u"), at_level("dst")("v")))
    alive = core.select("node", every(F.col("core"))).withColumn("id", at_level("node")("id"))
    placed = alive.join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").join(nodes.select("node", "w").hint("merge"), "node")
    placed = staged(placed.select("node", "l", F.coalesce("root", "id").alias("root"), "w"))
    large = placed.groupBy("l", "root").agg(F.sum("w").alias("size"), F.min("node").alias("one")).where(F.col("size") >= min_size)
    above = placed.select((F.col("l") - 1).alias("l"), F.col("node").alias("one"), F.col("root").alias("parent"))
    tree = staged(large.join(above.hint("merge"), ["l", "one"], "left").select("l", "root", "size", "parent"))
    chosen = _excess_of_mass(tree, [1 / x for x in grid])
    own = placed.join(chosen.hint("merge"), ["l", "root"]).groupBy("node").agg(F.max_by(F.struct("l", "root"), "l").alias("c")).select("node", "c.*")
    labelled = staged(named.join(nodes.join(own.hint("merge"), "node", "left"), ["reduced", "alone", "tied"]).select("vec_id", "l", "root"))
    least = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    numbered = least.withColumn("cluster_no", (F.row_number().over(W.orderBy("least")) - 1).cast("int"))
    return labelled.join(numbered.hint("merge"), "root", "left").select("vec_id", F.coalesce("cluster_no", F.lit(-1)).alias("cluster_no"), F.col("l").alias("level"))


def _level_forest(at: np.ndarray, rows: list[int], columns: list[int], levels: int) -> list[tuple[int, int, int]]:
    """Edges (node, node, level) of a minimum spanning forest of a matrix of levels."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    found = []
    for level in np.unique(at[at < levels]).tolist():
        for i, j in _forest(at <= level):
            a, b = top(rows[i]), top(columns[j])
            if a != b:
                up[a] = b
                found.append((rows[i], columns[j], level))
    return found


def _excess_of_mass(tree: DataFrame, gains: list[float]) -> DataFrame:
    """l and root of the clusters to take, at the level of their birth. ``tree``: components l, root, size and parent (root at the next level).

    From the smallest distance up, a component has the stability of its cluster
    so far and the best that the clusters below it give; one row each, so
    each level is one aggregation of its parts.
    """
    states, below = [], None
    for i, gain in enumerate(gains):
        own = tree.where(F.col("l") == i).withColumn("mass", F.col("size") * F.lit(gain - (gains[i + 1] if i + 1 < len(gains) else 0.0)))
        if below is None:
            state = own.withColumns({"parts": F.lit(0).cast("long"), "stability": F.col("mass"), "best": F.lit(0.0)})
        else:
            merged = below.groupBy(F.col("parent").alias("root")).agg(F.count("*").alias("parts"), F.sum("stability").alias("s"), F.sum("best").alias("b"), F.sum(F.greatest("stability", "best")).alias("split"))
            state = own.join(merged.hint("merge"), "root", "left").select("l", "root", "size", "parent", "mass", F.coalesce("parts", F.lit(0)).alias("parts"), (F.col("mass") + F.when(F.col("parts") == 1, F.col("s")).otherwise(0.0)).alias("stability"), F.when(F.col("parts") == 1, F.col("b")).otherwise(F.coalesce("split", F.lit(0.0))).alias("best"))
        below = staged(state.select("l", "root", "parent", "parts", "stability", "best"))
        states.append(below)
    whole = union_all(states)
    born = whole.join(whole.select((F.col("l") - 1).alias("l"), F.col("root").alias("parent"), F.col("parts").alias("siblings")).hint("merge"), ["l", "parent"], "left")
    return born.where("(siblings IS NULL OR siblings > 1) AND stability >= best").select("l", "root")


def cluster_items(vectors: DataFrame, n_components: int, min_size: int, min_samples: int, eps: float, run_id: int, levels: int = 1) -> tuple[DataFrame, DataFrame]:
    """V9. (clusters, members) of a new run: reduced, clustered, with distances to the centroid; noise has distance 0.

    One level is the flat cut at ``eps``; more are a hierarchy up to it, for clusters of differing density.
    """
    if vectors.limit(min_size).count() < min_size:
        raise ValueError("fewer vectors than the smallest cluster")
    reduced = staged(reduce_dims(vectors, n_components))
    found = density_cluster(reduced, min_size, min_samples, eps) if levels == 1 else density_hierarchy(reduced, min_size, min_samples, eps, levels).drop("level")
    joined = reduced.join(found, "vec_id")
    means = centroids(joined.where("cluster_no >= 0"), "cluster_no", "reduced").select("cluster_no", "centroid")
    members = joined.join(means.hint("merge"), "cluster_no", "left").select("vec_id", F.lit(run_id).alias("run_id"), "cluster_no", F.when(F.col("cluster_no") < 0, 0.0).otherwise(euclidean(F.col("reduced"), F.col("centroid"))).alias("distance"))
    members = staged(members)
    return members.groupBy("run_id", "cluster_no").agg(F.count("*").alias("size")), members


def run_row(spark: SparkSession, run_id: int, **params: object) -> DataFrame:
    """V9. The row of a run in cluster_runs: run_id, created_at and its parameters as JSON."""
    rows = spark.createDataFrame([(run_id, json.dumps(params, sort_keys=True))], "run_id long, params string")
    return rows.select("run_id", F.current_timestamp().alias("created_at"), "params")


def adopt_orphans(found: tuple[DataFrame, DataFrame], vectors: DataFrame, identities: DataFrame, assignments: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """V11. What a clustering of orphans changes: clusters labelled by the identities they match one to one, members, and the old assignments without the regions that found a cluster."""
    from filmroll.operators.matching import match_one_to_one

    clusters, members = found
    placed = members.where("cluster_no >= 0")
    own = centroids(placed.join(vectors, "vec_id"), "cluster_no")
    matched = match_one_to_one(own.select(F.col("cluster_no").cast("string").alias("cluster"), F.col("centroid").alias("vector")), identities.select("name", F.col("centroid").alias("vector")), threshold)
    named = clusters.join(matched.select(F.col("cluster").cast("int").alias("cluster_no"), F.col("name").alias("label_user")).hint("merge"), "cluster_no", "left")
    rest = assignments.join(placed.select(F.col("vec_id").alias("region_id")), "region_id", "left_anti")
    return {"clusters": named, "members": members, "assignments": rest}


def recluster_orphans(vectors: DataFrame, orphans: DataFrame, **options) -> tuple[DataFrame, DataFrame] | None:
    """V11. Cluster only the vectors of unidentified regions; None where there are too few."""
    pool = vectors.join(orphans.select(F.col("region_id").alias("vec_id")), "vec_id", "left_semi")
    return cluster_items(pool, **options) if pool.limit(options["min_size"]).count() >= options["min_size"] else None


def refine_noise(vectors: DataFrame, members: DataFrame, item_tags: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """V11b. Cluster the noise of a run again, and name what is found by frequent tags."""
    noise = members.where("cluster_no = -1").select(F.col("vec_id").alias("region_id"))
    found = recluster_orphans(vectors, noise, **options)
    if found is None:
        return None
    tagged = found[1].where("cluster_no >= 0").select(F.col("vec_id").alias("item_id"), "cluster_no").join(item_tags, "item_id")
    return (*found, freq_labels(tagged))


def cluster_regions(vectors: DataFrame, identities: DataFrame, log: DataFrame, threshold: float, **options) -> tuple[DataFrame, DataFrame]:
    """V10. Cluster regions, carry identities over one to one, and apply the log again."""
    from filmroll.operators.feedback import replay_corrections
    from filmroll.operators.matching import match_one_to_one

    clusters, members = cluster_items(vectors, **options)
    own = centroids(members.where("cluster_no >= 0").join(vectors, "vec_id"), "cluster_no")
    matched = match_one_to_one(own.select(F.col("cluster_no").cast("string").alias("cluster"), F.col("centroid").alias("vector")), identities.select("name", F.col("centroid").alias("vector")), threshold)
    named = clusters.join(matched.select(F.col("cluster").cast("int").alias("cluster_no"), F.col("name").alias("label_user")), "cluster_no", "left")
    moved, labelled = replay_corrections(log, members.withColumnRenamed("vec_id", "region_id"), named, options["run_id"])
    return labelled, moved


def tfidf_labels(tagged: DataFrame, clusters: DataFrame, top_k: int = 5) -> DataFrame:
    """A19. Labels of clusters from their tags (cluster_no, tag; a row per item and tag), noise being "noise".

    tf times (ln((N + 1) / (df + 1)) + 1), N being the clusters but noise; ties by tag.
    """
    real = clusters.where("cluster_no <> -1").select("cluster_no").distinct()
    tf = tagged.where("cluster_no <> -1").groupBy("cluster_no", "tag").agg(F.count("*").alias("tf"))
    df = tf.groupBy("tag").agg(F.count("*").alias("df"))
    total = real.agg(F.count("*").alias("n_all"))
    scored = tf.join(df, "tag").join(F.broadcast(total)).withColumn("score", F.col("tf") * (F.log((F.col("n_all") + 1) / (F.col("df") + 1)) + 1))
    return _joined_top(scored, "score", top_k, clusters)


def freq_labels(tagged: DataFrame, top_k: int = 5) -> DataFrame:
    """A20. Labels of clusters from their most frequent tags."""
    return _joined_top(tagged.groupBy("cluster_no", "tag").agg(F.count("*").alias("score")), "score", top_k, tagged)


def _joined_top(scored: DataFrame, by: str, top_k: int, clusters: DataFrame) -> DataFrame:
    order = W.partitionBy("cluster_no").orderBy(F.desc(by), "tag")
    best = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_k).groupBy("cluster_no").agg(F.array_sort(F.collect_list(F.struct("_n", "tag"))).alias("t"))
    named = clusters.select("cluster_no").distinct().join(best, "cluster_no", "left")
    return named.select("cluster_no", F.when(F.col("cluster_no") == -1, "noise").otherwise(F.array_join(F.transform("t", lambda x: x["tag"]), ", ")).alias("label_auto"))


def cluster_top_tags(tagged: DataFrame, top: int = 20) -> DataFrame:
    """A3. The most frequent tags of every cluster."""
    counted = tagged.groupBy("cluster_no", "tag").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(W.partitionBy("cluster_no").orderBy(F.desc("n"), "tag")).cast("long")).where(F.col("rank") <= top)


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """V22. For every cluster of run a the cluster of run b that shares most members, by Jaccard overlap (region_id, cluster_no)."""
    size = lambda m, c, n: m.groupBy(F.col("cluster_no").alias(c)).agg(F.count("*").alias(n))
    common = a.select("region_id", F.col("cluster_no").alias("a_no")).join(b.select("region_id", F.col("cluster_no").alias("b_no")), "region_id").groupBy("a_no", "b_no").agg(F.count("*").alias("common"))
    joined = common.join(size(a, "a_no", "na"), "a_no").join(size(b, "b_no", "nb"), "b_no").withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    return joined.withColumn("_n", F.row_number().over(W.partitionBy("a_no").orderBy(F.desc("jaccard"), "b_no"))).where("_n = 1").select("a_no", "b_no", "common", "jaccard")
