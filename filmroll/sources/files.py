"""Listing files, telling what changed, and taking that over into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import normalize_metadata

#: File name endings of images and of raw images.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif", "bmp", "gif")
RAW_EXTENSIONS = ("cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2")


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, include_raw: bool = False) -> DataFrame:
    """S1. path, size and mtime of the files under ``root``; the content is not read.

    The ending is compared in lower case, which a path filter would not do.
    """
    wanted = extensions + (RAW_EXTENSIONS if include_raw else ())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(wanted)})$")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def fingerprint(df: DataFrame, column: str = "content") -> DataFrame:
    """S2. Add a content hash."""
    return df.withColumn("hash", F.xxhash64(column))


def classify_changes(listing: DataFrame, catalog: DataFrame, hashes: DataFrame | None = None, force: bool = False) -> DataFrame:
    """S3. path and status (new, changed, unchanged, missing) from a listing and the catalog (path, mtime, hash).

    Equal mtime settles a path without its content. ``hashes`` (path, hash) of
    the paths left tells those whose content stayed; without it they are changed.
    """
    joined = listing.select("path", F.col("mtime").alias("_m")).join(catalog.select("path", F.col("mtime").alias("_old"), F.col("hash").alias("_h")), "path", "full_outer")
    if hashes is not None:
        joined = joined.join(hashes.select("path", F.col("hash").alias("_new")), "path", "left")
    else:
        joined = joined.withColumn("_new", F.lit(None).cast(catalog.schema["hash"].dataType))
    status = F.when(F.col("_old").isNull() & F.col("_h").isNull(), "new").when(F.col("_m").isNull(), "missing").when(F.lit(force), "changed")
    return joined.select("path", status.when(F.col("_m") == F.col("_old"), "unchanged").when(F.col("_h") == F.col("_new"), "unchanged").otherwise("changed").alias("status"))


def detect_moves(new: DataFrame, missing: DataFrame) -> DataFrame:
    """S4. from_path and to_path of missing files that turn up elsewhere with the same hash, one for one in path order."""
    order = W.partitionBy("hash").orderBy("path")
    a = missing.select("hash", F.col("path").alias("from_path"), F.row_number().over(order).alias("_n"))
    b = new.select("hash", F.col("path").alias("to_path"), F.row_number().over(order).alias("_n"))
    return a.join(b, ["hash", "_n"]).select("from_path", "to_path", "hash")


def prune(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """S5. Rows of the catalog whose file is gone; deleting them is a cascade."""
    return catalog.join(listing.select("path"), "path", "left_anti")


def metadata_backfill(items: DataFrame, raw: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """F8. (filled, counts): metadata of items that have none, or of all with ``force``, and the number of items by status.

    ``items``: item_id and metadata; ``raw``: item_id and a map of raw camera
    fields for the files that could be read. An item is skipped (it has
    metadata), missing (no file), empty (the file says nothing) or filled.
    """
    read = raw.select("item_id", F.col("raw").alias("_raw"), F.lit(True).alias("_read"))
    joined = items.select("item_id", F.col("metadata").isNotNull().alias("_has")).join(read, "item_id", "left").withColumn("_new", normalize_metadata(F.col("_raw")))
    status = F.when(F.col("_has") & F.lit(not force), "skipped").when(F.col("_read").isNull(), "missing").when(F.col("_new").isNull(), "empty").otherwise("filled")
    judged = joined.withColumn("status", status)
    return judged.where("status = 'filled'").select("item_id", F.col("_new").alias("metadata")), judged.groupBy("status").agg(F.count("*").alias("n"))


STATUSES = ("new", "changed", "unchanged", "missing")


def observe_counts(status: DataFrame) -> tuple[DataFrame, Observation]:
    """A23. The rows as they are, and an observation of their number by status, which is there once they have been written; no second job."""
    seen = Observation()
    return status.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]), seen


def ingest_counts(status: DataFrame) -> DataFrame:
    """A23. Number of rows by status."""
    return status.groupBy("status").agg(F.count("*").alias("n"))
