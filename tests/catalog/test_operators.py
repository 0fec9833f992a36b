"""Behaviour of the catalog operators on small tables."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.functions import scalars as X
from filmroll.operators import audit, clustering, feedback, matching, people, places, search, vectors
from filmroll.sources import export, files, tables


def ids(df, column="region_id"):
    return sorted(r[column] for r in df.select(column).collect())


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row


IDENTITY = "name string, centroid array<double>, n_samples long, sim_n long, sim_mean double, sim_m2 double"
VECTOR = "region_id long, embedding array<float>"


def identities(spark, *rows):
    return spark.createDataFrame([(n, [float(x) for x in c], k, 0, 0.0, 0.0) for n, c, k in rows], IDENTITY)


def test_degrees(spark):
    north = X.dms_to_degrees(F.array(F.lit(48.0), F.lit(53.0), F.lit(6.6)), F.lit("N"))
    row = one(spark, n=north, s=X.dms_to_degrees(F.array(F.lit(48.0), F.lit(53.0), F.lit(6.6)), F.lit("S")), bad=X.dms_to_degrees(F.array(F.lit(48.0)), F.lit("N")))
    assert row.n == pytest.approx(48.885166, abs=1e-5) and row.s == -row.n and row.bad is None


def test_dates_and_text(spark):
    row = one(spark, a=X.parse_date(F.lit("2024:01:15 13:45:30")), b=X.parse_date(F.lit("garbage")), c=X.parse_date(F.lit("  ")), d=X.clean_text(F.lit("abc\0")), e=X.clean_text(F.lit(" \0 ")))
    assert (row.a, row.b, row.c, row.d, row.e) == ("2024-01-15T13:45:30", "garbage", None, "abc", None)


def test_metadata(spark):
    raw = F.create_map(*map(F.lit, ("Make", " Samsung\0", "DateTime", "2024:01:15 13:45:30", "FNumber", "28/10", "ExposureTime", "1/250", "ISOSpeedRatings", "100", "GPSLatitude", "48, 53, 66/10", "GPSLatitudeRef", "N", "GPSLongitude", "2, 20, 0", "GPSLongitudeRef", "W")))
    row = one(spark, m=X.normalize_metadata(raw), none=X.normalize_metadata(F.create_map(F.lit("Other"), F.lit("x"))))
    assert row.m.make == "Samsung" and row.m.taken_at == "2024-01-15T13:45:30" and row.m.iso == 100 and row.m.f_number == 2.8
    assert row.m.gps.lat == pytest.approx(48.885, abs=1e-3) and row.m.gps.lon < 0 and row.none is None


def test_exposure_line(spark):
    row = one(spark, a=X.exposure_summary(F.lit(2.8), F.lit(0.004), F.lit(100), F.lit(50.0)), b=X.exposure_summary(F.lit(None).cast("double"), F.lit(2.0), F.lit(None).cast("int"), F.lit(None).cast("double")))
    assert row.a == "f/2.8 1/250s ISO 100 50mm" and row.b == "2.0s"


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip("xywh", v, strict=True)])
    row = one(spark, same=X.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), half=X.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)), none=X.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), inside=X.centre_inside(box(4, 4, 2, 2), box(0, 0, 6, 6)), cut=X.clamp_box(box(-5, 90, 20, 20), F.lit(100), F.lit(100)))
    assert row.same == 1.0 and row.half == pytest.approx(1 / 3) and row.none == 0.0 and row.inside and tuple(row.cut) == (0, 90, 20, 10)


def test_threshold_widens_with_spread(spark):
    def limit(sims):
        n, mean = len(sims), sum(sims) / len(sims)
        return one(spark, t=X.validate_threshold(0.7, F.lit(n), F.lit(mean), F.lit(sum((s - mean) ** 2 for s in sims)))).t

    assert limit([0.55, 0.95, 0.6, 0.85, 0.7]) > 0.75 > limit([0.85, 0.84, 0.86, 0.85, 0.86]) and limit([0.1, 0.9]) == 0.7


def test_search_dedups_tags_and_keeps_rows_below_out(spark):
    tags = spark.createDataFrame([(1, "cat", 0.9), (1, "smile", 0.8), (1, "cat", 0.1), (2, "cat", 0.95)], "item_id long, tag string, score double")
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, path string")
    found = search.search_by_all_tags(tags, items, ["cat", "cat", "smile"], 0.2).collect()
    assert [(r.item_id, round(r.mean_score, 3)) for r in found] == [(1, 0.85)]
    assert search.search_by_all_tags(tags, items, ["bird"]).isEmpty()


def test_vector_search_respects_filter(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.vector_search(v, [1.0, 0.1], 2).collect()] == [1, 2]
    assert [r.vec_id for r in search.vector_search(v, [1.0, 0.1], 5, allowed=v.where("vec_id = 2")).collect()] == [2]
    assert search.vector_search(v, [1.0, 0.0], 5, allowed=v.where("false")).isEmpty()


def test_replace_and_upsert(spark):
    base = spark.createDataFrame([("a", "geo", 1), ("b", None, 2)], "name string, kind string, v int")
    delta = spark.createDataFrame([("a", None, 5), ("b", "label", 6), ("c", None, 7)], "name string, kind string, v int")
    got = {r.name: (r.kind, r.v) for r in tables.upsert(base, delta, ["name"], keep_old=("kind",)).collect()}
    assert got == {"a": ("geo", 5), "b": ("label", 6), "c": (None, 7)}
    kept = {r.name: r.v for r in tables.upsert(base, delta, ["name"], ignore=True).collect()}
    assert kept == {"a": 1, "b": 2, "c": 7}
    again = tables.upsert(tables.upsert(base, delta, ["name"]), delta, ["name"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, tables.upsert(base, delta, ["name"]).collect()), key=str)


def test_cascade(spark):
    t = {
        "items": spark.createDataFrame([(1,), (2,)], "item_id long"),
        "item_tags": spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, tag string"),
        "regions": spark.createDataFrame([(10, 1), (20, 2)], "region_id long, item_id long"),
        "assignments": spark.createDataFrame([(10, 5), (20, 5)], "region_id long, cluster_id long"),
        "corrections": spark.createDataFrame([(1, 10, 1)], "id long, region_id long, item_id long"),
    }
    left = tables.cascade_delete(t, "items", spark.createDataFrame([(1,)], "item_id long"))
    assert {n: d.count() for n, d in left.items()} == {"items": 1, "item_tags": 1, "regions": 1, "assignments": 1, "corrections": 1}
    assert {n: d.count() for n, d in tables.purge(t).items()}["regions"] == 0


def test_vector_bytes_round_trip(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3],), (None,)], "v array<float>")
    back = df.select("v", tables.unpack_vector(tables.pack_vector("v")).alias("w")).collect()
    assert all(r.v == r.w for r in back)


def test_files(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt", "d.NEF"):
        (tmp_path / name).write_bytes(name.encode())
    assert files.scan_files(spark, str(tmp_path)).count() == 2
    assert files.scan_files(spark, str(tmp_path), include_raw=True).count() == 3
    catalog = spark.createDataFrame([("a", 1.0, 7), ("b", 1.0, 8), ("gone", 1.0, 9), ("c", 1.0, 5)], "path string, mtime double, hash long")
    listing = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("new", 1.0)], "path string, mtime double")
    hashes = spark.createDataFrame([("b", 8), ("c", 6), ("new", 9)], "path string, hash long")
    got = {r.path: r.status for r in files.classify_changes(listing, catalog, hashes).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "changed", "new": "new", "gone": "missing"}
    moved = files.detect_moves(hashes.where("path = 'new'"), catalog.where("path = 'gone'")).first()
    assert (moved.from_path, moved.to_path) == ("gone", "new")
    assert {r.path for r in files.prune(catalog, listing).collect()} == {"gone"}


def test_attach_cases(spark):
    known = identities(spark, ("Anne", [1, 0, 0], 5), ("Flat", [1, 0], 5))
    probes = spark.createDataFrame([(1, [0.95, 0.05, 0.0]), (2, [0.6, 0.8, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 0.0, 0.0, 0.0])], VECTOR)
    got = {r.region_id: (r.status, r.validated) for r in vectors.auto_attach(probes, known, 0.5, 0.05, 0.7).collect()}
    assert got == {1: ("matched", True), 2: ("matched", False), 3: ("below", False), 4: ("below", False)}


def test_attach_dry_run_tallies(spark):
    known = identities(spark, ("Anne", [1, 0, 0], 5), ("Bob", [0, 1, 0], 5))
    probes = spark.createDataFrame([(i, [0.99, 0.01, 0.0]) for i in range(3)] + [(i, [0.01, 0.99, 0.0]) for i in (3, 4)] + [(5, [0.0, 0.0, 1.0])], VECTOR)
    found = vectors.auto_attach(probes, known)
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"matched": 5, "below": 1}
    assert {r.name: (r.n, r.n_validated) for r in vectors.attach_histogram(found).collect()} == {"Anne": (3, 3), "Bob": (2, 2)}
    changes = vectors.persist_attach(found, probes, known, 9)
    assert changes["assignments"].count() == 5 and changes["verified"].count() == 5
    assert {r.name: r.n_samples for r in changes["identities"].collect()} == {"Anne": 8, "Bob": 7}


def test_attach_ambiguity_and_exclusion(spark):
    known = identities(spark, ("Anne", [1, 0], 5), ("Bea", [0, 1], 5))
    probe = spark.createDataFrame([(1, [0.707, 0.707])], VECTOR)
    assert vectors.auto_attach(probe, known, margin=0.05).first().status == "ambiguous"
    assert vectors.auto_attach(probe, known, margin=0.0).first().status == "matched"
    three = identities(spark, ("Anne", [1, 0, 0], 5), ("Bea", [0, 1, 0], 5))
    probes = spark.createDataFrame([(1, [0.9, 0.4, 0.0]), (2, [0.99, 0.01, 0.0])], VECTOR)
    gone = spark.createDataFrame([(1, "Anne")], "region_id long, label string")
    got = {r.region_id: (r.name, r.n_excluded) for r in vectors.auto_attach(probes, three, 0.3, 0.0, excluded=gone).collect()}
    assert got == {1: ("Bea", 1), 2: ("Anne", 0)}
    assert [r.name for r in vectors.suggest(probes, three, 2, gone).where("region_id = 1").collect()] == ["Bea"]


def test_top2_in_blocks_equals_one_matrix(spark, monkeypatch):
    rng = random.Random(3)
    known = identities(spark, *[(f"n{i:02d}", [rng.gauss(0, 1) for _ in range(4)], 1) for i in range(30)])
    probes = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)], VECTOR)
    gone = spark.createDataFrame([(i, f"n{i % 30:02d}") for i in range(40)], "region_id long, label string")
    keep = lambda df: sorted((r.region_id, r.name, round(r.sim, 6), round(r.second, 6), r.n_excluded) for r in df.collect())
    whole = keep(vectors.top2(probes, known, gone))
    monkeypatch.setattr(vectors, "MATRIX_ROWS", 5)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vectors, "PACK_ROWS", 15)
    assert keep(vectors.top2(probes, known, gone)) == whole


def test_suggest_in_blocks_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"n{i:02d}", [rng.gauss(0, 1) for _ in range(4)], 1) for i in range(25)]
    known = identities(spark, *rows, ("twin", rows[0][1], 1), ("flat", [1.0, 0.0], 1))  # a tie, and another dimension
    probes = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(90, [1.0, 1.0]), (91, [1.0]), (92, None)], VECTOR)
    gone = spark.createDataFrame([(i, f"n{i % 25:02d}") for i in range(30)], "region_id long, label string")
    keep = lambda df: sorted((r.region_id, r["rank"], round(r.sim, 6), r.ambiguous) for r in df.collect())
    names = lambda df: {(r.region_id, r.name) for r in df.collect()}
    whole = vectors.suggest(probes, known, 4, gone, gap=0.2)
    first = keep(whole), names(whole)
    monkeypatch.setattr(vectors, "MATRIX_ROWS", 5)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vectors, "PACK_ROWS", 15)
    blocks = vectors.suggest(probes, known, 4, gone, gap=0.2)
    assert (keep(blocks), names(blocks)) == first


def test_running_stats_merge(spark):
    sims = [0.85, 0.86, 0.84, 0.95, 0.55]
    stat = lambda x: F.struct(F.lit(len(x)).alias("n"), F.lit(sum(x) / len(x)).alias("mean"), F.lit(sum((v - sum(x) / len(x)) ** 2 for v in x)).alias("m2"))
    both = one(spark, m=vectors.merge_stats(stat(sims[:2]), stat(sims[2:]))).m
    mean = sum(sims) / 5
    assert both.n == 5 and both["mean"] == pytest.approx(mean) and math.sqrt(both.m2 / 4) == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in sims) / 4))


def test_merge_identities(spark):
    known = identities(spark, ("Anne", [1, 0], 300), ("Ann", [0, 1], 100), ("Flat", [1, 0, 0], 1))
    pairs = spark.createDataFrame([("Ann", "Anne"), ("Anne", "Anne"), ("Nobody", "Anne"), ("Flat", "Ann")], "loser string, survivor string")
    merged, rejected = vectors.merge_identities(known, pairs)
    row = merged.first()
    assert row.name == "Anne" and row.n_samples == 400 and row.centroid == pytest.approx([200 / 300, 100 / 300])
    assert sorted(r.reason for r in rejected.collect()) == ["dimension", "missing", "same"]


LOG = "id long, region_id long, action string, cluster_id long, name string"


def test_compaction(spark):
    log = spark.createDataFrame([(i, 1, "named", 1, f"n{i}") for i in range(5)] + [(10 + i, 2, "named", 1, f"m{i}") for i in range(3)] + [(20, 3, "unassigned", 1, None), (21, 3, "unassigned", 2, None), (30, None, "named", 1, "x")], LOG)
    assert sorted(r.name or "" for r in feedback.compact_log(log).collect()) == ["", "", "m2", "n4", "x"]


def test_constraint_edges(spark):
    names = [(1, 0, "named", 1, "Anne"), (2, 1, "named", 1, "Anne"), (3, 2, "named", 1, "Anne"), (4, 3, "named", 2, "Bea"), (5, 4, "named", 2, "Bea"), (6, 5, "unassigned", 1, None)]
    log = spark.createDataFrame(names, LOG)
    clusters = spark.createDataFrame([(1, "Anne"), (2, "Bea")], "cluster_id long, label_user string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(feedback.must_links(log)) == [(0, 1), (0, 2), (3, 4)]
    assert pairs(feedback.cannot_links(log, clusters)) == [(5, 0), (5, 1), (5, 2)]
    edges = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.5), (1, 2, 0.6)], "src long, dst long, weight double")
    must, cannot = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"), spark.createDataFrame([(2, 0)], "src long, dst long")
    assert pairs(feedback.apply_constraints(edges, must, cannot)) == [(0, 1, 0.0), (1, 2, 0.6)]


def test_cannot_links_are_whole(spark):
    """240 regions that rejected a name, against 240 that have it; edges are held against pairs and labels alike."""
    log = spark.range(480).selectExpr("id", "id AS region_id", "if(id < 240, 'named', 'unassigned') AS action", "1L AS cluster_id", "if(id < 240, 'Anne', NULL) AS name")
    clusters = spark.createDataFrame([(1, "Anne")], "cluster_id long, label_user string")
    assert feedback.cannot_links(log, clusters).count() == 240 * 240
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 300, 0.2), (300, 2, 0.3), (300, 301, 0.4), (7, 7, 0.5)], "src long, dst long, weight double")
    must = spark.createDataFrame([(3, 400), (4, 5)], "src long, dst long")
    got = [sorted(map(tuple, feedback.apply_constraints(edges, must, c).collect())) for c in (feedback.cannot_links(log, clusters), feedback.rejections(log, clusters))]
    assert got[0] == got[1] == [(0, 1, 0.1), (4, 5, 0.0), (7, 7, 0.5), (300, 301, 0.4)]


def test_cannot_links_of_a_hot_name_are_spread(spark, monkeypatch):
    """Almost all regions reject one name or have it: its pairs fill several tasks evenly; regions of several names and rejections give each pair once."""
    monkeypatch.setattr(feedback, "BLOCK_REGIONS", 16)
    monkeypatch.setattr(feedback, "TASK_PAIRS", 2_000)
    hot = spark.range(400).selectExpr("id", "id AS region_id", "if(id < 200, 'named', 'unassigned') AS action", "1L AS cluster_id", "if(id < 200, 'Anne', NULL) AS name")
    rest = [(500, 500, "named", 1, "Anne"), (500, 500, "named", 2, "Bea"), (501, 501, "unassigned", 1, None), (502, 501, "unassigned", 2, None), (503, 502, "unassigned", 1, None), (504, 502, "named", 1, "Anne")]
    clusters = spark.createDataFrame([(1, "Anne"), (2, "Bea")], "cluster_id long, label_user string")
    found = feedback.cannot_links(hot.union(spark.createDataFrame(rest, LOG)), clusters)
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a in [*range(200, 400), 501, 502] for b in [*range(200), 500, 502] if a != b)
    sizes = sorted(r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect())
    assert len(sizes) > 8 and sizes[-1] < 8_000


def test_replay(spark):
    log = spark.createDataFrame([(1, 1, "named", 1, "Anne"), (2, 2, "named", 1, "Bob"), (3, 3, "named", 1, "Eve"), (4, 3, "unassigned", 1, None)], LOG)
    assigned = spark.createDataFrame([(1, 7, 0, 0.1), (2, 7, 0, 0.2), (3, 7, 0, 0.3), (4, 7, -1, 0.0)], "region_id long, run_id int, cluster_no int, distance double")
    clusters = spark.createDataFrame([(70, 7, 0, None), (69, 7, -1, None)], "cluster_id long, run_id int, cluster_no int, label_user string")
    moved, labelled = feedback.replay_corrections(log, assigned, clusters, 7)
    assert {r.region_id: r.cluster_no for r in moved.collect()} == {1: 0, 2: 0, 3: -1, 4: -1}
    assert {r.cluster_no: r.label_user for r in labelled.collect()} == {0: "Anne", -1: None}


def test_triage_order(spark):
    labelled = spark.createDataFrame([(1, 1, 0, 10, "Anne"), (2, 1, 1, 11, "Carla"), (3, 1, 1, 11, "Carla"), (4, 1, 2, 12, "Daniel")], "region_id long, run_id int, cluster_no int, cluster_id long, label_user string")
    regions = spark.createDataFrame([(1, 100, None), (2, 200, 0), (3, 200, None), (4, 300, 1)], "region_id long, item_id long, user_verified int")
    assert [(r.item_id, r.n_unverified, r.n_dups, r.score) for r in people.triage_queue(labelled, regions).collect()] == [(200, 2, 1, 4), (100, 1, 0, 1)]


def test_latest_tie(spark):
    labelled = spark.createDataFrame([(1, 2, 0, 5, "a"), (1, 2, 1, 9, "b"), (1, 1, 0, 50, "c")], "region_id long, run_id int, cluster_no int, cluster_id long, label_user string")
    assert people.latest_assignment(labelled).first().label_user == "b"


def test_verify(spark):
    regions = spark.createDataFrame([(1, 0.95, 80, 80), (2, 0.40, 80, 80), (3, 0.95, 20, 20), (4, 0.1, None, None)], "region_id long, det_score double, w int, h int")
    row = people.verify_counts(people.verify_regions(regions)).first()
    assert (row.n_checked, row.n_kept, row.n_low_score, row.n_small, row.n_skipped, row.n_rejected) == (4, 1, 1, 1, 1, 2)


def test_audit_and_fix(spark):
    clusters = spark.createDataFrame([(10, 1, 0, "Anne", 99), (11, 1, 1, None, 0)], "cluster_id long, run_id int, cluster_no int, label_user string, size long")
    assigned = spark.createDataFrame([(1, 1, 0)], "region_id long, run_id int, cluster_no int")
    assert ids(audit.size_audit(assigned, clusters), "cluster_id") == [10]
    assert audit.size_audit(assigned, audit.fix_sizes(assigned, clusters)).isEmpty()


def test_rename_bulk(spark):
    clusters = spark.createDataFrame([(1, 0, "x")], "cluster_id long, cluster_no int, label_user string")
    mapping = spark.createDataFrame([("not-an-int", "Anne"), ("99999", "Bea"), ("1", "")], "key string, value string")
    applied, rejected = feedback.rename_bulk(clusters, mapping)
    assert [(r.cluster_id, r.label) for r in applied.collect()] == [(1, None)] and rejected.count() == 2


def test_density_clusters_blobs(spark):
    rng = random.Random(5)
    points = [(i, [c * 10 + rng.gauss(0, 0.3), c * 5 + rng.gauss(0, 0.3)]) for i, c in enumerate(k for k in range(3) for _ in range(30))] + [(90, [100.0, -50.0])]
    df = spark.createDataFrame(points, "vec_id long, reduced array<double>")
    got = {r.vec_id: r.cluster_no for r in clustering.density_cluster(df, 5, 4, 2.0).collect()}
    assert [len({got[i] for i in range(30 * c, 30 * c + 30)}) for c in range(3)] == [1, 1, 1]
    assert len({got[0], got[30], got[60]}) == 3 and got[90] == -1


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    """Groups of copies closer than eps, and scattered points, against DBSCAN* by all pairs; blocks of a few points."""
    monkeypatch.setattr(clustering, "CELL_POINTS", 8)
    rng = random.Random(7)
    points = [[0.0, 0.0, 0.0, 0.0]] * 20 + [[0.05, 0.0, 0.0, 0.0]] * 20 + [[5.0, 5.0, 5.0, 5.0]] * 3 + [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(150)]
    eps, min_samples, min_size = 0.35, 4, 5
    near = [[math.dist(p, q) <= eps for q in points] for p in points]
    core = [sum(row) - 1 >= min_samples for row in near]
    root = list(range(len(points)))
    for _ in points:
        before = list(root)
        for i, row in enumerate(near):
            if core[i]:
                root[i] = min(root[j] for j, x in enumerate(row) if x and core[j])
        if root == before:
            break
    number = {r: n for n, r in enumerate(sorted(r for r in set(root) if root.count(r) >= min_size))}
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, reduced array<double>")
    got = {r.vec_id: r.cluster_no for r in clustering.density_cluster(df, min_size, min_samples, eps).collect()}
    assert got == {i: number.get(r, -1) for i, r in enumerate(root)} and got[0] == got[20] == 0
    must, cannot = spark.createDataFrame([(40, 0), (41, 42)], "src long, dst long"), spark.createDataFrame([(0, 1)], "src long, dst long")
    tied = {r.vec_id: r.cluster_no for r in clustering.density_cluster(df, min_size, min_samples, eps, (must, cannot)).collect()}
    assert tied[40] == tied[0] == tied[1] == 0 and tied[41] == tied[42] == -1


def test_matching_is_near_the_best(spark):
    rng = random.Random(11)
    unit = lambda: [rng.gauss(0, 1) for _ in range(3)]
    a, b = [(f"c{i}", unit()) for i in range(4)], [(f"n{i}", unit()) for i in range(5)]
    got = matching.match_one_to_one(spark.createDataFrame(a, "cluster string, vector array<double>"), spark.createDataFrame(b, "name string, vector array<double>"), -1.0).collect()
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    best = max(sum(cos(a[i][1], b[j][1]) for i, j in enumerate(p)) for p in itertools.permutations(range(5), 4))
    assert len({r.cluster for r in got}) == len({r.name for r in got}) == 4 and sum(r.sim for r in got) > best - 1e-9
    pairs = spark.createDataFrame([(x, y, cos(p, q)) for x, p in a for y, q in b], "cluster string, name string, sim double")
    assert sum(r.sim for r in matching.auction(pairs, 5e-3).collect()) > best - 0.03


def test_boxes_merge(spark):
    schema = "region_id long, item_id long, user_verified int, box struct<x:int,y:int,w:int,h:int>"
    old = spark.createDataFrame([(1, 1, 1, (0, 0, 10, 10)), (2, 1, 1, (50, 50, 5, 5)), (3, 1, None, (0, 0, 9, 9))], schema)
    new = spark.createDataFrame([(11, 1, None, (1, 0, 10, 10)), (12, 1, None, (80, 80, 5, 5))], schema)
    assert ids(matching.redetect_merge(old, new)) == [1, 12]
    request = spark.createDataFrame([(7, 1, (0, 0, 20, 20))], "request_id long, item_id long, box struct<x:int,y:int,w:int,h:int>")
    assert people.pick_region(request, new.withColumn("det_score", F.lit(0.9))).first().region_id == 11


def test_nearest_place_both_ways(spark):
    rng = random.Random(2)
    gaz = spark.createDataFrame([(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(300)], "place_id long, lat double, lon double")
    pts = spark.createDataFrame([(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(200)] + [(999, None, 1.0)], "item_id long, lat double, lon double")
    keep = lambda df: sorted((r.item_id, r.place_id) for r in df.collect())
    assert keep(places.nearest_place(pts, gaz)) == keep(places.nearest_place(pts, gaz, at_most=10))


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, path string")
    tags = spark.createDataFrame([(1, "cat", 0.9), (1, "dog", 0.95)], "item_id long, tag string, score double")
    export.export_json(items, tags, str(tmp_path / "j"), 0.5)
    back = {r.item_id: [t.name for t in r.tags] for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert back == {1: ["dog", "cat"], 2: []}
    export.export_csv(items, tags, str(tmp_path / "c"))
    assert {r.tags for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"dog:0.95,cat:0.90", None}


def test_sidecars(spark):
    plan = spark.createDataFrame([("a", 5.0, ["x & y", "z"], ["c|z"]), ("b", 5.0, ["q"], [])], "path string, mtime double, subjects array<string>, hierarchical array<string>")
    there = spark.createDataFrame([("a", 6.0, ["z", "x & y", "z"]), ("b", 4.0, ["q"])], "path string, sidecar_mtime double, existing_subjects array<string>")
    assert {r.path: r.status for r in export.sidecar_diff(plan, there).collect()} == {"a": "skipped", "b": "written"}
    packet = export.sidecar_packets(plan).where("sidecar_path = 'a.xmp'").first().body
    assert "<rdf:li>x &amp; y</rdf:li>" in packet and "c|z" in packet


def test_gif_files_are_listed(spark, tmp_path):
    for name in ("a.gif", "b.JPG", "c.txt", "d.raf"):
        (tmp_path / name).write_bytes(b"x")
    found = [r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["a.gif", "b.JPG"]


def test_boxes_are_matched_like_a_plain_greedy_choice(spark):
    rng = random.Random(31)
    box = lambda: tuple(rng.randint(0, 12) for _ in range(2)) + tuple(rng.randint(4, 12) for _ in range(2))
    old, new = ([(i, i % 4, box()) for i in range(n, n + 40)] for n in (0, 100))
    schema = "region_id long, item_id long, box struct<x:int,y:int,w:int,h:int>"
    got = {(r.item_id, r.old_id, r.new_id) for r in matching.match_boxes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 0.2).collect()}

    def overlap(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        common = max(w, 0) * max(h, 0)
        return common / (a[2] * a[3] + b[2] * b[3] - common)

    want, used = set(), set()
    for i, item, a in sorted(old, key=lambda r: (-r[2][2] * r[2][3], r[0])):
        free = [(-overlap(a, b), j) for j, other, b in new if other == item and j not in used and overlap(a, b) >= 0.2]
        if free:
            used.add(min(free)[1])
            want.add((item, i, min(free)[1]))
    assert got == want and len(want) > 10


def test_an_auction_that_does_not_end_says_so(spark):
    pairs = spark.createDataFrame([(f"c{i}", f"n{j}", 1 - 0.01 * abs(i - j)) for i in range(5) for j in range(5)], "cluster string, name string, sim double")
    with pytest.raises(RuntimeError, match="did not end"):
        matching.auction(pairs, rounds=1)


@pytest.mark.parametrize(("n", "m"), [(200, 200), (30, 7), (7, 30), (1, 1)])
def test_exact_matching_proves_itself(n, m):
    """Near ties: prices are feasible and sum up to the total, so no matching is better."""
    rng = np.random.default_rng(n + m)
    gain = np.round(1.5 + rng.normal(0, 1e-3, (n, m)), 5) * (rng.random((n, m)) > 0.2)
    found, u, v = matching.assign(gain)
    taken = found[found >= 0]
    total = gain[np.flatnonzero(found >= 0), taken].sum()
    assert len(set(taken)) == len(taken) and (u > -1e-9).all() and (v > -1e-9).all()
    assert (u[:, None] + v >= gain - 1e-9).all() and abs(u.sum() + v.sum() - total) < 1e-6


def test_matching_by_components(spark, monkeypatch):
    """Matched apart, components give what the whole gives."""
    rng = random.Random(4)
    groups = [[[rng.gauss(0, 1) if k == g else rng.gauss(0, 0.02) for k in range(3)] for _ in range(2 + g)] for g in range(3)]
    places = [[1.0 if k == g else 0.0 for k in range(3)] for g in range(3)]
    near = lambda g: [p + rng.gauss(0, 0.1) for p in places[g]]
    a = [(f"c{g}{i}", near(g)) for g in range(3) for i in range(len(groups[g]))]
    b = [(f"n{g}{i}", near(g)) for g in range(3) for i in range(3)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, vector array<double>")
    whole = matching.match_one_to_one(frame(a, "cluster"), frame(b, "name"), 0.8).collect()
    monkeypatch.setattr(matching, "CELLS", 30)
    apart = matching.match_one_to_one(frame(a, "cluster"), frame(b, "name"), 0.8).collect()
    assert len(apart) == 8 and all(r.cluster[1] == r.name[1] for r in apart)
    assert {(r.cluster, r.name) for r in whole} == {(r.cluster, r.name) for r in apart}


def test_orphans_are_adopted(spark):
    v = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(3)] + [(i, [0.0, 1.0]) for i in range(3, 6)], "vec_id long, embedding array<double>")
    clusters = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, -1, 1)], "run_id int, cluster_no int, size long")
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, -1)], "vec_id long, cluster_no int")
    known = spark.createDataFrame([("Anne", [1.0, 0.0])], "name string, centroid array<double>")
    old = spark.createDataFrame([(0, 9), (5, 9), (7, 9)], "region_id long, run_id int")
    changes = clustering.adopt_orphans((clusters, members), v, known, old)
    assert {r.cluster_no: r.label_user for r in changes["clusters"].collect()} == {0: "Anne", 1: None, -1: None}
    assert ids(changes["assignments"]) == [5, 7]
    row = clustering.run_row(spark, 4, eps=0.5, min_size=3).first()
    assert row.run_id == 4 and row.params == '{"eps": 0.5, "min_size": 3}' and row.created_at is not None
