"""Nearest places by blocks against plain distances: poles, the date line, a dense city, a far place and ties."""

from __future__ import annotations

import math
import random

import pytest

from filmroll.operators import places


def km(a, b):
    p, q, x, y = map(math.radians, (a[0], b[0], a[1], b[1]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
    return 2 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_find_the_nearest_place(spark, monkeypatch, seed):
    monkeypatch.setattr(places, "BLOCK_PLACES", 7)
    rng = random.Random(seed)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)] + [(48.85 + rng.gauss(0, 0.01), 2.35 + rng.gauss(0, 0.01)) for _ in range(300)]
    spots += [(89.99, 10.0), (89.99, -170.0), (-90.0, 0.0), (0.0, 179.999), (0.0, -179.999), (-60.0, -140.0)]
    known = list(enumerate(spots)) + [(9000, spots[5]), (8999, spots[5])]  # ties go to the least id
    asked = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    asked += [(100, 90.0, 77.0), (101, -89.9, -100.0), (102, 0.001, 180.0), (103, 0.0, -180.0), (104, *spots[5]), (105, 48.851, 2.351), (106, None, 1.0), (107, -61.0, -150.0)]
    frame = spark.createDataFrame([(i, *s) for i, s in known], "place_id long, lat double, lon double")
    points = spark.createDataFrame(asked, "item_id long, lat double, lon double")
    got = {r.item_id: (r.place_id, r.km) for r in places.nearest_place(points, frame, at_most=10).collect()}
    small = {r.item_id: (r.place_id, r.km) for r in places.nearest_place(points, frame).collect()}
    assert got.keys() == small.keys() == {a[0] for a in asked if a[1] is not None}
    for i, lat, lon in asked:
        if lat is not None:
            near = min(km((lat, lon), s) for _, s in known)
            assert abs(got[i][1] - small[i][1]) < 1e-6 and km((lat, lon), dict(known)[got[i][0]]) <= near + 1e-9
    assert got[104][0] == 5


def test_no_block_is_large(spark, monkeypatch):
    """A dense city and one far place: blocks stay at their size, so no key holds many places or points."""
    monkeypatch.setattr(places, "BLOCK_PLACES", 8)
    monkeypatch.setattr(places, "PACK_POINTS", 16)
    rng = random.Random(3)
    city = [(i, 48 + rng.gauss(0, 1e-4), 2 + rng.gauss(0, 1e-4)) for i in range(400)] + [(400, -45.0, 170.0)]
    points = spark.createDataFrame([(i, 48 + rng.gauss(0, 1e-4), 2 + rng.gauss(0, 1e-4)) for i in range(200)], "item_id long, lat double, lon double")
    frame = spark.createDataFrame(city, "place_id long, lat double, lon double")
    got = {r.item_id: r.km for r in places.nearest_place(points, frame, at_most=1).collect()}
    want = {r.item_id: r.km for r in places.nearest_place(points, frame).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
