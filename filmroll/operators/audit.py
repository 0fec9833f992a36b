"""Checks that a catalog is consistent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.functions.scalars import validate_threshold
from filmroll.operators.people import NOISE


def actual_sizes(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """A11. Clusters with the number of members they have."""
    counts = assignments.groupBy("run_id", "cluster_no").agg(F.count("*").alias("_n"))
    return clusters.join(counts, ["run_id", "cluster_no"], "left").withColumn("actual", F.coalesce("_n", F.lit(0))).drop("_n")


def size_audit(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """A11. Clusters whose recorded size is wrong."""
    return actual_sizes(assignments, clusters).where("actual <> size")


def fix_sizes(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """A11. Clusters with sizes counted anew."""
    return actual_sizes(assignments, clusters).withColumn("size", F.col("actual")).select(*clusters.columns)


def missing_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """P11. Rows whose vector is null or empty."""
    return vectors.where(F.col(column).isNull() | (F.size(column) == 0))


def orphan_identities(identities: DataFrame, clusters: DataFrame) -> DataFrame:
    """J9. Identities whose name no cluster carries."""
    return identities.join(clusters.where("label_user IS NOT NULL").select(F.col("label_user").alias("name")).distinct(), "name", "left_anti")


def catalog_audit(assignments: DataFrame, clusters: DataFrame, vectors: DataFrame, identities: DataFrame, item_assignments: DataFrame | None = None, item_clusters: DataFrame | None = None) -> DataFrame:
    """A12. All findings as rows (check, key, detail); a sound catalog has none.

    With the clusters of items given as well, their sizes are checked too.
    """
    row = lambda df, check, key, detail: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), detail.alias("detail"))
    sizes = row(size_audit(assignments, clusters), "size", "cluster_id", F.format_string("%d recorded, %d there", F.col("size").cast("long"), F.col("actual")))
    empty = row(missing_vectors(vectors), "vector", "vec_id", F.lit("missing"))
    orphans = row(orphan_identities(identities, clusters), "identity", "name", F.lit("no cluster"))
    noise = row(clusters.where((F.col("cluster_no") == NOISE) & F.col("label_user").isNotNull()), "noise", "cluster_id", F.lit("labelled"))
    if item_clusters is not None:
        sizes = sizes.unionByName(row(size_audit(item_assignments, item_clusters), "item size", "cluster_id", F.format_string("%d recorded, %d there", F.col("size").cast("long"), F.col("actual"))))
    return sizes.unionByName(empty).unionByName(orphans).unionByName(noise)


def region_stats(regions: DataFrame) -> DataFrame:
    """A13. Counters over all regions."""
    yes = F.coalesce("user_verified", F.lit(-1))
    return regions.agg(F.count("*").alias("n_regions"), F.count_if(yes == 1).alias("n_verified"), F.count_if(yes == 0).alias("n_unverified"), F.count_if(yes == -1).alias("n_open"), F.count_distinct("item_id").alias("n_items"))


def identity_thresholds(stats: DataFrame, base: float = 0.7) -> DataFrame:
    """A13. The threshold in force for each identity (name, n, mean, m2)."""
    return stats.withColumn("threshold", validate_threshold(base, F.col("n"), F.col("mean"), F.col("m2")))
