"""Category rules: which tags, clusters and items belong to a category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_rules(tag_category: DataFrame, cluster_category: DataFrame, item_category: DataFrame) -> DataFrame:
    """J18. All rules as rows (layer, target, category), in that order."""
    row = lambda df, layer, key: df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("target"), "category")
    layers = row(tag_category, "tag", "tag").unionByName(row(cluster_category, "cluster", "cluster_id")).unionByName(row(item_category, "item", "item_id"))
    return layers.orderBy("layer", "target", "category")


def category_counts(categories: DataFrame, tag_category: DataFrame, cluster_category: DataFrame) -> DataFrame:
    """A21. Number of tag and of cluster rules of every category, those without any at 0."""
    count = lambda df, name: df.groupBy("category").agg(F.count("*").alias(name))
    joined = categories.select("category").distinct().join(count(tag_category, "n_tags"), "category", "left")
    return joined.join(count(cluster_category, "n_clusters"), "category", "left").fillna(0, ["n_tags", "n_clusters"])


def add_rules(rules: DataFrame, new: DataFrame, targets: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J18. (rules, rejected) with ``new`` rules taken in: the target has to be among ``targets`` and the category among ``categories``.

    All frames name the target alike, in the first column of ``rules``; the other is category.
    """
    target = rules.columns[0]
    known = targets.select(target).distinct().withColumn("_target", F.lit(True))
    named = categories.select("category").distinct().withColumn("_category", F.lit(True))
    judged = new.select(target, "category").join(known, target, "left").join(named, "category", "left")
    judged = judged.withColumn("reason", F.when(F.col("_target").isNull(), "unknown target").when(F.col("_category").isNull(), "unknown category"))
    taken = rules.select(target, "category").unionByName(judged.where("reason IS NULL").select(target, "category")).distinct()
    return taken, judged.where("reason IS NOT NULL").select(target, "category", "reason")
