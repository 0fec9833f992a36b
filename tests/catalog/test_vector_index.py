"""Batch search against brute force, with ties, copies, hot cells and vectors of length 0."""

from __future__ import annotations

import random

import numpy as np
import pytest

from filmroll.operators import vector_index
from tests.conftest import DATA


def brute(vectors, queries, k):
    unit = lambda m: np.divide(m, n := np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=n > 0)
    ids = np.array(sorted(vectors))
    x = unit(np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64))
    out = {}
    for q, v in queries.items():
        sims = x @ unit(np.array([v], dtype=np.float64))[0]
        out[q] = [(int(ids[i]), round(float(sims[i]), 6)) for i in np.lexsort((ids, -np.round(sims, 12)))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.sim, 6)))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    vectors = {i: [x + rng.gauss(0, 0.2) for x in rng.choice(base)] for i in range(400)}
    vectors |= {i: vectors[3] for i in range(400, 520)} | {520: [0.0] * 6, 521: [0.0] * 6}
    queries = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(40)} | {40: vectors[3], 41: [0.0] * 6}
    schema = "{} long, embedding array<float>"
    odd = [(600, None), (601, [1.0]), (602, [None] * 6)]
    frame = spark.createDataFrame([*vectors.items(), *odd], schema.format("vec_id"))
    asked = spark.createDataFrame([*queries.items(), (90, None), (91, [1.0])], "query_id long, embedding array<double>")
    return vectors, queries, frame, asked


def test_exact_search_equals_brute_force(spark, monkeypatch, case, tmp_path):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_index, "PACK_ROWS", 7)
    vectors, queries, frame, asked = case
    index = vector_index.build_index(frame, 6, 9)
    got = found(vector_index.batch_search(index, asked, 15, probes=1))
    want = brute(vectors, queries, 15)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == [s for _, s in want[q]]
    assert got[40][:14] == [(3, 1.0)] + [(i, 1.0) for i in range(400, 413)]  # ties by vec_id
    vector_index.write_index(index, str(tmp_path / "index"))
    again = vector_index.read_index(spark, str(tmp_path / "index"), 6)
    assert found(vector_index.batch_search(again, asked, 15, probes=1)) == got


def test_more_hits_than_vectors_and_empty_tables(spark, case):
    _, _, frame, asked = case
    few = vector_index.build_index(frame.where("vec_id < 3"), 6)
    assert {len(v) for v in found(vector_index.batch_search(few, asked, 10)).values()} == {3}
    none = vector_index.build_index(frame.limit(0), 6)
    assert vector_index.batch_search(none, asked, 3).collect() == []
    assert vector_index.batch_search(few, asked.limit(0), 3).collect() == []


def test_recall_of_the_first_cells(spark):
    """The given vectors are spread almost evenly over all directions, so the nearest ten lie in many cells: 28 of 44 hold 0.9 of them."""
    vectors = spark.read.parquet(str(DATA / "sf0.1" / "embeddings.parquet"))
    index = vector_index.build_index(vectors, 64)
    asked = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    exact = vector_index.batch_search(index, asked, 10).select("query_id", "vec_id")
    near = vector_index.batch_search(index, asked, 10, probes=28, exact=False).select("query_id", "vec_id")
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count() and len(index.map.cells) == 44
