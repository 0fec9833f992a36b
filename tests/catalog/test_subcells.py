"""Dense sub-cells of the density clustering, against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from filmroll.operators import clustering


def brute(points: np.ndarray, min_size: int, min_samples: int, eps: float) -> list[int]:
    """DBSCAN* by all pairs: numbers of clusters by their least point, -1 for noise."""
    total = np.zeros((len(points), len(points)))
    for j in range(points.shape[1]):
        total += (points[:, j][:, None] - points[:, j][None, :]) ** 2
    near = np.sqrt(total) <= eps
    core = near.sum(axis=1) - 1 >= min_samples
    root, seen = list(range(len(points))), set()
    for i in np.flatnonzero(core).tolist():
        todo = [] if i in seen else [i]
        seen.update(todo)
        while todo:
            k = todo.pop()
            root[k] = i
            more = [j for j in np.flatnonzero(near[k] & core).tolist() if j not in seen]
            seen.update(more)
            todo += more
    sizes = {r: root.count(r) for r in set(root)}
    number = {r: n for n, r in enumerate(sorted(r for r in sizes if sizes[r] >= min_size))}
    return [number.get(r, -1) for r in root]


def run(spark, points: np.ndarray, *options, **more) -> list[int]:
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, reduced array<double>").repartition(3)
    got = {r.vec_id: r.cluster_no for r in clustering.density_cluster(df, *options, **more).collect()}
    return [got[i] for i in range(len(points))]


@pytest.mark.parametrize(("seed", "dims", "eps"), [(1, 2, 0.3), (2, 3, 0.5), (3, 1, 0.02)])
def test_dense_and_loose_points_equal_brute_force(spark, monkeypatch, seed, dims, eps):
    """Dense blobs, some of them just apart, on thin bridges and among scattered points; blocks of a few points."""
    monkeypatch.setattr(clustering, "CELL_POINTS", 16)
    monkeypatch.setattr(clustering, "TIP_ROWS", 3)
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, 0.25 * eps, (60, dims)) for c in rng.uniform(-3, 3, (5, dims))]
    points = np.concatenate([*blobs, rng.uniform(-3, 3, (150, dims)), np.zeros((9, dims)), np.linspace(-1, 1, 12)[:, None].repeat(dims, 1)])
    points = points[rng.permutation(len(points))]
    assert run(spark, points, 6, 4, eps) == brute(points, 6, 4, eps)


def sheets(gap: float) -> np.ndarray:
    """Two dense sheets in neighbouring sub-cells, whose outermost points are far from each other: only inner ones come as near as ``gap``."""
    rng = random.Random(4)
    side = 1 / math.sqrt(2) * (1 - 1e-9)
    low = [(side - 0.5 + rng.uniform(-0.1, 0.1), rng.uniform(0.0, 0.05)) for _ in range(30)]
    high = [(side - 0.4 + gap, 0.6) for _ in range(30)]
    return np.array([*low, *high, (side - 0.05, 0.02), (side + gap - 0.05, 0.02), *[(side + 0.55 + rng.uniform(0, 0.1), 0.65) for _ in range(30)]])


@pytest.mark.parametrize("gap", [0.3, 0.9, 1.0, 1.2, 2.5])
def test_sub_cells_apart_or_not(spark, monkeypatch, gap):
    monkeypatch.setattr(clustering, "CELL_POINTS", 4)
    points = sheets(gap)
    assert run(spark, points, 5, 8, 1.0) == brute(points, 5, 8, 1.0)


@pytest.mark.parametrize(("shift", "joined"), [(0.9, True), (0.95, False)])
def test_open_pairs_are_settled_by_points(spark, monkeypatch, shift, joined):
    """Boxes within eps, no outermost points within eps: inner points decide, both ways."""
    monkeypatch.setattr(clustering, "CELL_POINTS", 4)
    links, seen = clustering._cell_links, []

    def spied(*args):
        found = links(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(clustering, "_cell_links", spied)
    near, far = [(0.3, 0.0), (0.0, 0.3), (0.25, 0.25), (0.0, 0.0)], [(0.0, 0.3), (0.3, 0.0), (0.05, 0.05), (0.3, 0.3)]
    points = np.array([*near * 3, *[(x + shift, y + shift) for x, y in far * 3]])
    got = run(spark, points, 5, 8, 1.0)
    assert got == brute(points, 5, 8, 1.0) == [0] * 12 + [0 if joined else 1] * 12 and seen == [int(joined)]


def test_awkward_inputs(spark):
    empty = spark.createDataFrame([], "vec_id long, reduced array<double>")
    assert clustering.density_cluster(empty, 2, 1, 1.0).collect() == []
    same = np.array([[1.0, 2.0]] * 7 + [[9.0, 9.0]])
    assert run(spark, same, 3, 2, 0.0) == run(spark, same, 3, 2, 0.5) == [0] * 7 + [-1]
    wide = np.array([[1e300, 1.0]] * 4 + [[-1e300, 1.0]] * 4 + [[2e18, 1.0], [4e18, 1.0]] * 3)
    assert run(spark, wide, 3, 2, 0.5) == brute(wide, 3, 2, 0.5)


def test_constraints_hold_inside_a_dense_cell(spark):
    """Named points stay on their own: a cannot-link between two of them leaves what others join, a must-link brings a far one in."""
    points = np.array([[0.01 * i, 0.0] for i in range(30)] + [[9.0, 9.0]])
    must = spark.createDataFrame([(30, 3)], "src long, dst long")
    cannot = spark.createDataFrame([(4, 5)], "src long, dst long")
    assert run(spark, points, 5, 4, 1.0, (must, cannot)) == [0] * 31


def test_a_cell_of_many_points(spark):
    """40,000 points in a few cells: only sub-cells meet, so no pair of blocks of them is opened."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.uniform(0, 1, (20000, 3)), rng.uniform(0, 1, (20000, 3)) + [3.0, 0, 0]])
    assert run(spark, points, 100, 5, 1.0) == [0] * 20000 + [1] * 20000


def test_only_cells_that_loose_points_meet_are_put_into_blocks(spark, monkeypatch):
    """Dense cells far from loose points stay out of blocks; copies of one point near them are one."""
    monkeypatch.setattr(clustering, "CELL_POINTS", 16)
    blocks, seen = clustering._blocks, []

    def spied(nodes, *more):
        seen.append(found := blocks(nodes, *more))
        return found

    monkeypatch.setattr(clustering, "_blocks", spied)
    points = np.concatenate([np.linspace(0, 500, 20_001), np.full(400, 500.3), [501.35, 501.4, 600.0]])[:, None]
    assert run(spark, points, 6, 5, 1.0) == [0] * (len(points) - 3) + [-1] * 3
    assert sum(r[0] for found in seen for r in found.selectExpr("size(points)").collect()) < 2_000
