"""Listings as a data source, and a stream that ingests from it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from filmroll.sources import files, listing
from filmroll.sources.buckets import BucketTable
from filmroll.streaming import streams


def write(path, content, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (at, at))


def test_listing_deals_folders(spark, tmp_path):
    listing.register(spark)
    for i, name in enumerate(["a.jpg", "x/b.PNG", "x/y/c.tif", "z/d.jpg", "z/e.txt", "z/f.nef", "z/deep/er/g.webp"]):
        write(tmp_path / name, bytes([i]) * 3_000_000 if i == 0 else bytes([i]), 1000.0 + i)
    load = lambda **o: spark.read.format("media_files").options(**o).load(str(tmp_path))
    assert load().rdd.getNumPartitions() == 3  # the root's own files, x and z
    names = lambda df: {os.path.relpath(r.path, tmp_path): (r.size, r.mtime) for r in df.collect()}
    want = {"a.jpg": (3_000_000, 1000.0), "x/b.PNG": (1, 1001.0), "x/y/c.tif": (1, 1002.0), "z/d.jpg": (1, 1003.0), "z/deep/er/g.webp": (1, 1006.0)}
    assert names(load()) == names(load(depth=2)) == names(load(depth=3)) == want
    assert names(load(include_raw=True)) == want | {"z/f.nef": (1, 1005.0)}
    hashed = {r.path: r.hash for r in load(hash=True).collect()}
    spark_hash = files.fingerprint(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)))
    assert hashed == {r.path.removeprefix("file:"): r.hash for r in spark_hash.collect() if r.path.removeprefix("file:") in hashed} and len(hashed) == 5
    assert load().where(F.col("path").contains("nothing")).count() == 0


def test_ingest_from_the_listing(spark, tmp_path):
    listing.register(spark)
    root, schema = tmp_path / "in", spark.createDataFrame([], "path string, mtime double, hash long").schema
    table, seen = BucketTable(str(tmp_path / "items"), schema, ("path",), 8), []
    take = lambda: streams.stream_ingest(spark.readStream.format("media_files").option("hash", True).load(str(root)).select("path", "mtime", "hash"), table, str(tmp_path / "c"), lambda n, counts: seen.append(counts)).awaitTermination(120)
    write(root / "a/1.jpg", b"one", 1000.0)
    write(root / "b/2.jpg", b"two", 1001.0)
    take()
    first = {os.path.basename(r.path): r.hash for r in table.read(spark).collect()}
    (root / "b/2.jpg").write_bytes(b"other")
    (root / "b/3.jpg").write_bytes(b"three")
    take()
    second = {os.path.basename(r.path): r.hash for r in table.read(spark).collect()}
    assert first.keys() == {"1.jpg", "2.jpg"} and second.keys() == {"1.jpg", "2.jpg", "3.jpg"}
    assert second["1.jpg"] == first["1.jpg"] and second["2.jpg"] != first["2.jpg"]
    assert [(c["new"], c["changed"]) for c in seen if sum(c.values())] == [(2, 0), (1, 1)]
