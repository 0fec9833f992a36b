"""Regions, their assignments to clusters, and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import json_field

NOISE = -1


def labelled_assignments(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """J4. Assignments (region_id, run_id, cluster_no, distance) with cluster_id and label_user of their clusters."""
    return assignments.join(clusters.select("run_id", "cluster_no", "cluster_id", "label_user"), ["run_id", "cluster_no"])


def latest_assignment(labelled: DataFrame) -> DataFrame:
    """W1. Each region's assignment of its latest run; of two in one run that of the larger cluster_id."""
    order = W.partitionBy("region_id").orderBy(F.desc("run_id"), F.desc("cluster_id"))
    return labelled.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def attach_similarity(distance: Column, manual: Column) -> Column:
    """W1. Similarity of a manual attachment, 0 to 1; null for clustered regions."""
    return F.when(manual, F.least(F.greatest(1 - distance, F.lit(0.0)), F.lit(1.0)))


def latest_run(runs: DataFrame, manual: bool = False) -> DataFrame:
    """W7. The newest run, or the newest with ``manual`` set in its parameters."""
    pool = runs.where(json_field(F.col("params"), "$.manual").isin("1", "true")) if manual else runs
    return pool.agg(F.max("run_id").alias("run_id"))


def unidentified(regions: DataFrame, labelled: DataFrame) -> DataFrame:
    """J5. Regions that have a label in no run at all."""
    return regions.join(labelled.where(F.col("label_user").isNotNull()).select("region_id").distinct(), "region_id", "left_anti")


def named_unvalidated(regions: DataFrame, labelled: DataFrame) -> DataFrame:
    """J6. Regions with a label in some run that nobody has confirmed."""
    named = labelled.where(F.col("label_user").isNotNull()).select("region_id").distinct()
    return regions.where(F.coalesce("user_verified", F.lit(0)) == 0).join(named, "region_id", "left_semi")


def validated(regions: DataFrame, yes: bool = True) -> DataFrame:
    """P10. Regions that are confirmed, or are not."""
    return regions.where((F.coalesce("user_verified", F.lit(0)) == 1) == F.lit(yes))


def verify_regions(regions: DataFrame, min_score: float = 0.65, min_area: int = 1024) -> DataFrame:
    """P9. Add low_score, small and the verdict; a region without a box stays unjudged."""
    low = F.col("det_score") < min_score
    small = F.col("w") * F.col("h") < min_area
    boxed = F.col("w").isNotNull() & F.col("h").isNotNull()
    return regions.withColumns({"low_score": boxed & low, "small": boxed & small, "skipped": ~boxed, "kept": F.when(boxed, ~(low | small))})


def verify_counts(judged: DataFrame) -> DataFrame:
    """P9. The counters of a verification."""
    return judged.agg(
        F.count("*").alias("n_checked"),
        F.count_if("kept").alias("n_kept"),
        F.count_if("low_score").alias("n_low_score"),
        F.count_if("small").alias("n_small"),
        F.count_if("skipped").alias("n_skipped"),
        F.count_if(F.col("low_score") | F.col("small")).alias("n_rejected"),
    )


def duplicates_to_drop(labelled: DataFrame, regions: DataFrame, keep: DataFrame) -> DataFrame:
    """J7. Unconfirmed regions with the label of a kept one (item_id, label, region_id) on the same item."""
    latest = latest_assignment(labelled).join(validated(regions, False).select("region_id", "item_id"), "region_id")
    wanted = keep.select("item_id", F.col("label").alias("label_user"), F.col("region_id").alias("_keep"))
    return latest.join(wanted, ["item_id", "label_user"]).where(F.col("region_id") != F.col("_keep")).select("region_id").distinct()


def triage_queue(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """A8. Items to look at: unconfirmed named regions, and names that occur more than once among them.

    Two narrow aggregates: by item and name, then by item.
    """
    latest = latest_assignment(labelled).where(F.col("label_user").isNotNull())
    open_ = latest.join(validated(regions, False).select("region_id", "item_id"), "region_id")
    names = open_.groupBy("item_id", "label_user").agg(F.count("*").alias("n"))
    queue = names.groupBy("item_id").agg(F.sum("n").alias("n_unverified"), F.count_if(F.col("n") >= 2).alias("n_dups"))
    return queue.withColumn("score", F.col("n_unverified") + 2 * F.col("n_dups")).orderBy(F.desc("score"), F.desc("n_unverified"), "item_id")


def duplicate_names(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """A9. Names that an item shows more than once by the latest runs."""
    latest = latest_assignment(labelled).where(F.col("label_user").isNotNull()).join(regions.select("region_id", "item_id"), "region_id")
    return latest.groupBy("item_id", "label_user").agg(F.count("*").alias("n")).where("n > 1")


def named_people(labelled: DataFrame, regions: DataFrame, prefix: str | None = None) -> DataFrame:
    """A5. Items and clusters per name."""
    named = labelled.where(F.col("label_user").isNotNull()).join(regions.select("region_id", "item_id"), "region_id")
    named = named.where(F.col("label_user").ilike(prefix + "%")) if prefix else named
    return named.groupBy("label_user").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("cluster_id").alias("n_clusters"))


def region_summary(regions: DataFrame) -> DataFrame:
    """A6. Number of regions and of items that have any."""
    return regions.agg(F.count("*").alias("n_regions"), F.count_distinct("item_id").alias("n_items"))


def items_with_regions(regions: DataFrame) -> DataFrame:
    """A7. Regions per item, most first."""
    return regions.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id")


def run_summary(clusters: DataFrame) -> DataFrame:
    """A4. Clusters, noise and total members per run."""
    noise = F.col("cluster_no") == NOISE
    return clusters.groupBy("run_id").agg(F.count_if(~noise).alias("n_clusters"), F.coalesce(F.sum(F.when(noise, F.col("size"))), F.lit(0)).alias("n_noise"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"))


def unnamed_clusters(clusters: DataFrame, run_id: int) -> DataFrame:
    """P6. Clusters of a run without a label, largest first; noise is none."""
    return clusters.where((F.col("run_id") == run_id) & F.col("label_user").isNull() & (F.col("cluster_no") != NOISE)).orderBy(F.desc("size"), "cluster_id")


def cluster_order(clusters: DataFrame) -> DataFrame:
    """P7. Named clusters first, then by size."""
    return clusters.orderBy(F.col("label_user").isNull(), F.desc("size"), "cluster_id")


def split_label(clusters: DataFrame, name: str) -> DataFrame:
    """W5. Give the clusters of one label numbered names, the largest first."""
    order = W.partitionBy("label_user").orderBy(F.desc("size"), "cluster_id")
    return clusters.where((F.col("label_user") == name) & (F.col("cluster_no") != NOISE)).withColumn("new_label", F.concat_ws(" ", "label_user", F.row_number().over(order).cast("string")))


def person_view(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """A22. Per name: clusters, items and members."""
    named = labelled.where(F.col("label_user").isNotNull()).join(regions.select("region_id", "item_id"), "region_id")
    return named.groupBy("label_user").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("region_id").alias("n_regions"))


def pick_region(requests: DataFrame, detections: DataFrame) -> DataFrame:
    """V21. For each drawn box the best detection whose centre lies in it."""
    from filmroll.functions.scalars import centre_inside

    joined = requests.withColumnRenamed("box", "_drawn").join(detections, "item_id").where(centre_inside(F.col("box"), F.col("_drawn")))
    return joined.groupBy("request_id").agg(F.max_by(F.struct("region_id", "box", "det_score"), F.struct("det_score", -F.col("region_id"))).alias("best")).select("request_id", "best.*")
