"""Nearest places of points on the globe."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.functions.scalars import haversine
from filmroll.sources.staging import small, staged

#: Places that are sent to every executor; larger gazetteers are joined by block.
GAZETTEER_ROWS = 10_000
#: Places of a block at least, and blocks at most: beyond, blocks grow. Their boxes go to every executor.
BLOCK_PLACES, MAX_BLOCKS = 256, 100_000
#: Blocks under one box of the upper level, and points that meet a block at once.
FANOUT, PACK_POINTS = 256, 4_096
#: Bits of a coordinate in the order of places.
BITS = 20


def nearest_place(points: DataFrame, places: DataFrame, at_most: int = GAZETTEER_ROWS) -> DataFrame:
    """J12. item_id, place_id and km of the nearest place (place_id, lat, lon) of every point (item_id, lat, lon); ties by place_id.

    A small gazetteer is an array that every row reduces. A larger one is
    laid out along a space-filling curve over the globe in three dimensions,
    where neither poles nor the date line are special, and cut into blocks of
    equal size with their bounding boxes. A point is sent to the blocks that can
    hold its nearest place: none of their corners is farther than the nearest
    block's farthest one. Points of a block are dealt into packs, so neither a dense
    city nor a far place makes a long task.
    """
    points = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("item_id", "lat", "lon")
    places = places.where("lat IS NOT NULL AND lon IS NOT NULL")
    if small(places, at_most):
        one = places.agg(F.collect_list(F.struct("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))).alias("_places"))
        each = lambda p: F.struct(haversine(F.col("lat"), F.col("lon"), p["plat"], p["plon"]).alias("km"), p["place_id"].alias("place_id"))
        return points.join(F.broadcast(one)).select("item_id", F.array_min(F.transform("_places", each)).alias("b")).where("b IS NOT NULL").select("item_id", "b.place_id", "b.km")
    return _nearest_by_block(points, places)


def _on_globe(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places as unit vectors."""
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _curve(lat: Column, lon: Column) -> Column:
    """Place on the curve: the bits of the three coordinates in turn."""
    a, b = F.radians(lat), F.radians(lon)
    axes = [F.floor((x + 1) / 2 * ((1 << BITS) - 1)) for x in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]
    bits = [F.shiftleft(F.shiftright(axis.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + k) for k, axis in enumerate(axes) for i in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _nearest_by_block(points: DataFrame, places: DataFrame) -> DataFrame:
    spark = places.sparkSession
    own = staged(places.select(F.col("place_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("curve", _curve(F.col("lat"), F.col("lon"))))
    size = max(BLOCK_PLACES, -(-own.count() // MAX_BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ``size`` places in the order of the curve, with their boxes."""
        first, n, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in chain(batches, [None]):
            held = held if batch is None else pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held is not None and (held.num_rows >= size or batch is None and held.num_rows):
                run, held = held.slice(0, size), held.slice(size)
                xyz = _on_globe(run["lat"].to_numpy(), run["lon"].to_numpy())
                columns = [[first + n], *([run[c].to_pylist()] for c in ("place_id", "lat", "lon")), [xyz.min(axis=0)], [xyz.max(axis=0)]]
                kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "ids", "lats", "lons", "low", "high"])
                n += 1

    sorted_ = own.repartitionByRange("curve", "place_id").sortWithinPartitions("curve", "place_id").select(F.col("place_id").cast("long").alias("place_id"), "lat", "lon")
    blocks = staged(sorted_.mapInArrow(cut, "block long, ids array<long>, lats array<double>, lons array<double>, low array<double>, high array<double>"))
    boxes = blocks.select("block", "low", "high").orderBy("block").collect()  # MAX_BLOCKS and one for each partition at most
    names, low, high = np.array([r["block"] for r in boxes]), np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    starts = np.arange(0, len(names), FANOUT)
    upper_low, upper_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    tree = spark.sparkContext.broadcast((names, low, high, upper_low, upper_high))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high, upper_low, upper_high = tree.value
        for batch in batches:
            asked, found = [], []
            for i, x in enumerate(_on_globe(batch.column("lat").to_numpy(), batch.column("lon").to_numpy())):
                above = _nearest_corner(x, upper_low, upper_high)
                top = int(np.argmin(above))
                inner = slice(top * FANOUT, (top + 1) * FANOUT)
                reach = _farthest_corner(x, low[inner], high[inner]).min() + 1e-12
                near = [np.flatnonzero(_nearest_corner(x, low[s], high[s]) <= reach) + s.start for s in (slice(t * FANOUT, (t + 1) * FANOUT) for t in np.flatnonzero(above <= reach).tolist())]
                hits = np.concatenate(near)
                asked.append(np.full(len(hits), i))
                found.append(names[hits])
            at = pa.array(np.concatenate(asked) if asked else np.empty(0, int))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("item_id", "lat", "lon")), pa.array(np.concatenate(found) if found else np.empty(0, int), pa.int64())], names=["item_id", "lat", "lon", "block"])

    item = points.schema["item_id"].dataType.simpleString()
    wanted = staged(points.select("item_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).mapInArrow(ask, f"item_id {item}, lat double, lon double, block long"))
    sizes = wanted.groupBy("block").agg(F.ceil(F.count("*") / PACK_POINTS).alias("packs"))
    dealt = wanted.join(sizes, "block").withColumn("pack", F.pmod(F.xxhash64("item_id", "lat", "lon"), F.col("packs")))
    packs = dealt.groupBy("block", "pack").agg(F.collect_list(F.struct("item_id", "lat", "lon")).alias("asked"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each point and block the nearest places, ties and next to ties as well."""
        for batch in batches:
            for asked, ids, lats, lons in zip(*(batch.column(c) for c in ("asked", "ids", "lats", "lons")), strict=True):
                items, lat, lon = asked.values.flatten()
                ids, lats, lons = (x.values.to_numpy() for x in (ids, lats, lons))
                here, there = _on_globe(lat.to_numpy(), lon.to_numpy()), _on_globe(lats, lons)
                for at in range(0, len(here), 512):
                    apart = np.zeros((len(here[at : at + 512]), len(there)))
                    for k in range(3):
                        apart += (here[at : at + 512, k][:, None] - there[None, :, k]) ** 2
                    row, hit = np.nonzero(apart <= apart.min(axis=1, keepdims=True) + 1e-14)
                    take = pa.array(row + at)
                    yield pa.RecordBatch.from_arrays([items.take(take), lat.take(take), lon.take(take), *(pa.array(x[hit]) for x in (ids, lats, lons))], names=["item_id", "lat", "lon", "place_id", "plat", "plon"])

    met = packs.join(blocks.select("block", "ids", "lats", "lons").hint("merge"), "block").select("asked", "ids", "lats", "lons")
    hits = met.mapInArrow(meet, f"item_id {item}, lat double, lon double, place_id long, plat double, plon double")
    best = hits.groupBy("item_id", "lat", "lon").agg(F.min(F.struct(haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")).alias("km"), "place_id")).alias("b"))
    return best.select("item_id", "b.place_id", "b.km")


def _nearest_corner(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to the nearest place that each box can hold."""
    return (np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum(axis=1)


def _farthest_corner(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point to the farthest place that each box can hold."""
    return (np.maximum(np.abs(low - x), np.abs(high - x)) ** 2).sum(axis=1)


def geo_tags(items: DataFrame, nearest: DataFrame, places: DataFrame, existing: DataFrame) -> DataFrame:
    """J13. Tags (item_id, tag, score, model_name) of city and country for items that have no geo tags yet."""
    done = existing.where("model_name = 'geo_v1'").select("item_id").distinct()
    found = items.select("item_id").join(done, "item_id", "left_anti").join(nearest, "item_id").join(places, "place_id")
    tags = F.array(F.lower("city"), F.lower("country"))
    return found.select("item_id", F.explode(F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))).alias("tag"), F.lit(1.0).alias("score"), F.lit("geo_v1").alias("model_name"))
