"""Clusters of differing density against a plain computation of the hierarchy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from filmroll.operators import clustering


def brute(points, min_size, min_samples, eps, levels):
    """points: {vec_id: place}; sets of ids of the chosen clusters, and of the clusters of each cut."""
    ids = sorted(points)
    x = np.array([points[i] for i in ids])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    grid = clustering.level_grid(eps, levels)
    at = []
    for e in grid:
        core = [i for i in range(len(ids)) if (dist[i] <= e).sum() - 1 >= min_samples]
        left, comps = set(core), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                near = {j for j in left if dist[i, j] <= e}
                left -= near
                todo += near
            comps.append(frozenset(seen))
        at.append([c for c in comps if len(c) >= min_size])

    def follow(comp, level):
        """Stability of the cluster from this component on, and the best choice below it with its value."""
        gain = 1 / grid[level] - (1 / grid[level + 1] if level + 1 < levels else 0.0)
        parts = [c for c in at[level - 1] if c <= comp] if level else []
        if len(parts) == 1:
            s, value, picks = follow(parts[0], level - 1)
            return s + len(comp) * gain, value, picks
        value, picks = 0.0, []
        for p in parts:
            s, v, inner = follow(p, level - 1)
            value += max(s, v)
            picks += [p] if s >= v else inner
        return len(comp) * gain, value, picks

    out = []
    for comp in at[-1]:
        s, v, inner = follow(comp, levels - 1)
        out += [comp] if s >= v else inner
    named = lambda comps: {frozenset(ids[i] for i in c) for c in comps}
    return named(out), [named(comps) for comps in at]


def clusters(rows):
    found = {}
    for r in rows:
        if r.cluster_no >= 0:
            found.setdefault(r.cluster_no, set()).add(r.vec_id)
    assert sorted(found, key=lambda c: min(found[c])) == sorted(found)
    return {frozenset(c) for c in found.values()}


def frame(spark, points):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in points.items()], "vec_id long, reduced array<double>")


def test_blobs_of_differing_density_with_a_bridge(spark):
    """Two dense blobs close together and one wide blob: no single distance tells all three apart."""
    rng = random.Random(3)
    points, n = {}, 0
    for x, y, spread, size in ((0, 0, 0.03, 40), (0.45, 0, 0.03, 40), (9, 0, 1.5, 60)):
        for _ in range(size):
            points[n] = (rng.gauss(x, spread), rng.gauss(y, spread))
            n += 1
    for k in range(6):  # the bridge
        points[n] = (0.6 + 0.9 * k, 0.02 * k)
        n += 1
    want, cuts = brute(points, 12, 4, 4.0, 12)
    got = clusters(clustering.density_hierarchy(frame(spark, points), 12, 4, 4.0, 12).collect())
    assert got == want and len(want) == 3 and all(len(c) < 3 for c in cuts)
    assert sorted(min(c) for c in want)[:2] == [0, 40]


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_equals_brute_force(spark, monkeypatch, seed):
    """Random places with ties and copies, over many small blocks."""
    monkeypatch.setattr(clustering, "CELL_POINTS", 9)
    rng = random.Random(seed)
    points = {}
    for i in range(150):
        c = rng.choice([(0, 0, 0), (3, 1, 0), (3, 2, 1)])
        points[i * 3] = tuple(round(rng.gauss(m, rng.choice([0.1, 0.3, 1.0])), 1) for m in c)
    got = clusters(clustering.density_hierarchy(frame(spark, points), 6, 3, 2.0, 6).collect())
    assert got == brute(points, 6, 3, 2.0, 6)[0] and got


def test_hierarchy_of_little(spark):
    assert clustering.density_hierarchy(frame(spark, {}), 2, 1, 1.0, 3).collect() == []
    lone = clustering.density_hierarchy(frame(spark, {1: (0,), 2: (9,), 3: (9,), 4: (9,)}), 3, 2, 1.0, 3).collect()
    assert {(r.vec_id, r.cluster_no) for r in lone} == {(1, -1), (2, 0), (3, 0), (4, 0)}
