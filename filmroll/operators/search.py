"""Finding items by tags, people and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import cosine, tag_kind


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """P1. Rows with these column values; reaches the Parquet scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def search_by_all_tags(item_tags: DataFrame, items: DataFrame, tags: list[str], min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """A1. Items that carry every tag at ``min_score`` or better, with their mean score, best first."""
    wanted = list(dict.fromkeys(tags))
    hits = item_tags.where(F.col("tag").isin(wanted) & (F.col("score") >= min_score))
    hits = hits.groupBy("item_id").agg(F.avg("score").alias("mean_score"), F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted)).drop("n")
    found = hits.join(items.select("item_id", "path"), "item_id").orderBy(F.desc("mean_score"), "item_id")
    return found.limit(limit) if limit is not None else found


def with_cluster(found: DataFrame, memberships: DataFrame, run_id: int) -> DataFrame:
    """J3. Each hit with its cluster of one run, or none; the run is filtered before the join."""
    own = memberships.where(F.col("run_id") == run_id).groupBy("item_id").agg(F.min("cluster_id").alias("cluster_id"))
    return found.join(own, "item_id", "left")


def search_by_all_people(labelled: DataFrame, regions: DataFrame, names: list[str], run_id: int | None = None) -> DataFrame:
    """J10. Items that show every named person, optionally by one run only. ``labelled``: region_id, run_id, label_user."""
    wanted = list(dict.fromkeys(names))
    named = labelled.where(F.col("label_user").isin(wanted))
    named = named.where(F.col("run_id") == run_id) if run_id is not None else named
    per_item = named.join(regions.select("region_id", "item_id"), "region_id").groupBy("item_id").agg(F.count_distinct("label_user").alias("n"))
    return per_item.where(F.col("n") == len(wanted)).select("item_id")


def hits_by_cluster(found: DataFrame) -> DataFrame:
    """J19. Search hits gathered by their cluster."""
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("item_id"))), ",").alias("item_ids"))


def split_tags(item_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J1. (tags, facts) of flat rows (item_id, tag, score, model_name): each tag of a kind once, with an id, and facts that name the id.

    The id is a hash of tag and kind, so tables split at different times agree.
    """
    keyed = item_tags.withColumn("kind", tag_kind(F.col("model_name"))).withColumn("tag_id", F.xxhash64("tag", "kind"))
    return keyed.select("tag_id", "tag", "kind").distinct(), keyed.select("item_id", "tag_id", "score", "model_name")


def tagged_items(facts: DataFrame, tags: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """J1. Facts (item_id, tag_id, ...) with the tags (tag_id, tag, kind) they name, and the path of their items if ``items`` are given."""
    named = facts.join(tags.select("tag_id", "tag", "kind"), "tag_id").drop("tag_id")
    return named if items is None else named.join(items.select("item_id", "path"), "item_id")


def list_tags(item_tags: DataFrame, min_score: float = 0.0) -> DataFrame:
    """P3. Tags above a score, best first."""
    return item_tags.where(F.col("score") >= min_score).orderBy(F.desc("score"), "tag")


def tag_prefix(tags: DataFrame, prefix: str | None = None, kind: str | None = None, include_geo: bool = True) -> DataFrame:
    """P4. Tags that start with ``prefix`` in any case (% and _ are wildcards) and are of a kind; no kind means label."""
    own = F.coalesce(F.col("kind"), F.lit("label"))
    if prefix:
        tags = tags.where(F.col("tag").ilike(prefix + "%"))
    if kind:
        tags = tags.where(own == kind)
    return tags if include_geo else tags.where(own != "geo")


def token_filter(df: DataFrame, column: str, query: str) -> DataFrame:
    """P8. Rows whose text holds every white-space separated part of the query, in any case."""
    return df.where(F.forall(F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda t: t != ""), lambda t: F.contains(F.lower(F.col(column)), t)))


def tags_per_item(ids: DataFrame, item_tags: DataFrame) -> DataFrame:
    """J2. Every asked item with its tags, best first; items without any have an empty list."""
    best = item_tags.groupBy("item_id", "tag").agg(F.max("score").alias("score"))
    lists = ids.select("item_id").distinct().join(best, "item_id", "left").groupBy("item_id").agg(F.sort_array(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct((-F.col("score")).alias("s"), "tag")))).alias("t"))
    return lists.select("item_id", F.transform("t", lambda x: x["tag"]).alias("tags"))


def item_profile(items: DataFrame, item_tags: DataFrame, item_category: DataFrame) -> DataFrame:
    """P2. Every item in one record: path, tags with scores, manual category."""
    entry = F.struct((-F.col("score")).alias("s"), "tag", "score")
    tags = item_tags.groupBy("item_id", "tag").agg(F.max("score").alias("score")).groupBy("item_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    tags = tags.select("item_id", F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), x["score"].alias("score"))).alias("tags"))
    return items.join(tags, "item_id", "left").join(item_category, "item_id", "left")


def tag_histogram(item_tags: DataFrame, prefix: str | None = None, kind: str | None = None, include_geo: bool = True, limit: int | None = None) -> DataFrame:
    """A2. Number of rows per tag, most frequent first."""
    kinds = item_tags.withColumn("kind", tag_kind(F.col("model_name")))
    counted = tag_prefix(kinds, prefix, kind, include_geo).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
    return counted.limit(limit) if limit is not None else counted


def vector_search(vectors: DataFrame, query: list[float], k: int, allowed: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """V1. The k most similar vectors, among the ``allowed`` ids only; filters go before the scores."""
    pool = vectors.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi") if allowed is not None else vectors
    scored = pool.select("vec_id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("sim"))
    scored = scored.where(F.col("sim") >= min_score) if min_score is not None else scored
    return scored.orderBy(F.desc("sim"), "vec_id").limit(k)


def hybrid_search(items: DataFrame, item_tags: DataFrame, labelled: DataFrame, regions: DataFrame, vectors: DataFrame, query: list[float] | None = None, k: int = 50, tags: list[str] | None = None, people: list[str] | None = None, run_id: int | None = None, min_score: float = 0.0) -> DataFrame:
    """V1, U2. item_id, path, mean_score and sim of items with all ``tags`` and all ``people`` (of one run, if named), nearest to ``query`` first.

    Without a query vector the best mean score comes first; what is not asked
    for is null. Filters go before the scores; ``vectors``: item_id, embedding.
    """
    pool = items.select("item_id", "path")
    if tags:
        pool = search_by_all_tags(item_tags, items, tags, min_score).select("item_id", "path", "mean_score")
    else:
        pool = pool.withColumn("mean_score", F.lit(None).cast("double"))
    if people:
        pool = pool.join(search_by_all_people(labelled, regions, people, run_id), "item_id", "left_semi")
    if query is None:
        return pool.withColumn("sim", F.lit(None).cast("double")).orderBy(F.desc_nulls_last("mean_score"), "item_id").limit(k)
    asked = vectors.select("item_id", "embedding").where("embedding IS NOT NULL").join(pool, "item_id")
    scored = asked.select("item_id", "path", "mean_score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("sim"))
    return scored.orderBy(F.desc("sim"), "item_id").limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """W2, W3. The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def first_appearance(ranked: DataFrame, group: list[str], item: str, rank: str = "rank") -> DataFrame:
    """W9. Distinct items of a ranked list at their first place."""
    return ranked.groupBy(*group, item).agg(F.min(rank).alias(rank))


def categories_for_items(item_tags: DataFrame, memberships: DataFrame, tag_category: DataFrame, cluster_category: DataFrame, item_category: DataFrame) -> DataFrame:
    """U4. Categories of every item: the manual one alone, else those of its tags and clusters together."""
    by_tag = item_tags.select("item_id", "tag").distinct().join(tag_category, "tag").select("item_id", "category")
    by_cluster = memberships.select("item_id", "cluster_id").join(cluster_category, "cluster_id").select("item_id", "category")
    rules = by_tag.union(by_cluster).distinct().join(item_category, "item_id", "left_anti")
    return rules.union(item_category.select("item_id", "category")).groupBy("item_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def most_populated(df: DataFrame, column: str) -> DataFrame:
    """A10. The most frequent value, the least on ties."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)
