"""One query per operator over the given tables, with the SQL that expects the same rows."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions import scalars as X
from filmroll.functions import scoring
from filmroll.operators import audit, clustering, feedback, matching, people, places, rules, search, vector_index, vectors
from filmroll.plans.views import ctes, view
from filmroll.sources import export, files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TAGS = ["Brand#1", "Brand#2"]


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of these views' DataFrames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLE_SQL[name] = ctes(sql)
        return f

    return add


def joined(column: str | Column) -> Column:
    """An array as text."""
    return F.array_join(column, ",")


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# --- search, facets, lists


@query("a01_search_by_all_tags", "item_tags", "items", sql="""
SELECT t.item_id, round(avg(score), 6) AS mean_score, any_value(path) AS path FROM item_tags t JOIN items i ON t.item_id = i.item_id
WHERE tag IN ('Brand#1', 'Brand#2') AND score >= 0.2 GROUP BY t.item_id HAVING count(DISTINCT tag) = 2""")
def _(item_tags, items):
    return search.search_by_all_tags(item_tags, items, TAGS, 0.2).withColumn("mean_score", F.round("mean_score", 6))


@query("j03_search_with_cluster", "item_tags", "items", "members", sql="""
SELECT h.item_id, h.mean_score, m.cluster_id FROM (
  SELECT item_id, round(avg(score), 6) AS mean_score FROM item_tags WHERE tag IN ('Brand#1', 'Brand#2') AND score >= 0.2 GROUP BY item_id HAVING count(DISTINCT tag) = 2) h
LEFT JOIN (SELECT * FROM members WHERE run_id = 1) m ON h.item_id = m.item_id""")
def _(item_tags, items, members):
    found = search.search_by_all_tags(item_tags, items, TAGS, 0.2)
    return search.with_cluster(found, members, 1).select("item_id", r6("mean_score"), "cluster_id")


@query("j19_hits_by_cluster", "item_tags", "items", "members", sql="""
SELECT cluster_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM (
  SELECT h.item_id, m.cluster_id FROM (SELECT item_id FROM item_tags WHERE tag IN ('Brand#1', 'Brand#2') AND score >= 0.2 GROUP BY item_id HAVING count(DISTINCT tag) = 2) h
  LEFT JOIN members m ON h.item_id = m.item_id) x GROUP BY cluster_id""")
def _(item_tags, items, members):
    return search.hits_by_cluster(search.with_cluster(search.search_by_all_tags(item_tags, items, TAGS, 0.2), members, 1))


@query("j10_search_by_all_people", "labelled", "regions", sql="""
SELECT r.item_id FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE label_user IN ('NATION_1', 'NATION_2', 'NATION_4')
GROUP BY r.item_id HAVING count(DISTINCT label_user) = (SELECT count(DISTINCT label_user) FROM labelled WHERE label_user IN ('NATION_1', 'NATION_2', 'NATION_4'))""")
def _(labelled, regions):
    names = [r[0] for r in labelled.where(F.col("label_user").isin("NATION_1", "NATION_2", "NATION_4")).select("label_user").distinct().collect()]
    return search.search_by_all_people(labelled, regions, names)


@query("j10_search_by_people_in_run", "labelled", "regions", sql="""
SELECT r.item_id FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE run_id = 2 AND label_user IN (SELECT label_user FROM clusters WHERE run_id = 2 AND cluster_no IN (1, 2))
GROUP BY r.item_id HAVING count(DISTINCT label_user) = 2""")
def _(labelled, regions):
    names = [r[0] for r in labelled.where("run_id = 2 AND cluster_no IN (1, 2)").select("label_user").distinct().collect()]
    return search.search_by_all_people(labelled, regions, names, 2)


@query("p01_lookup", "items", sql="SELECT item_id, path, hash FROM items WHERE item_id = 77")
def _(items):
    return search.lookup(items, item_id=77).select("item_id", "path", "hash")


@query("p03_list_tags", "item_tags", sql="SELECT item_id, tag, score, model_name FROM item_tags WHERE score >= 0.9")
def _(item_tags):
    return search.list_tags(item_tags, 0.9)


@query("p04_tag_prefix", "item_tags", sql="""
SELECT tag, count(*) AS n FROM item_tags WHERE tag ILIKE 'brand#1%' AND model_name NOT LIKE 'geo^_%' ESCAPE '^' GROUP BY tag""")
def _(item_tags):
    return search.tag_histogram(item_tags, "brand#1", None, include_geo=False)


@query("a02_tag_histogram", "item_tags", sql="SELECT tag, count(*) AS n FROM item_tags GROUP BY tag")
def _(item_tags):
    return search.tag_histogram(item_tags)


@query("a02_geo_histogram", "item_tags", sql="SELECT tag, count(*) AS n FROM item_tags WHERE starts_with(model_name, 'geo_') GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def _(item_tags):
    return search.tag_histogram(item_tags, kind="geo", limit=10)


@query("p08_token_filter", "items", sql="SELECT item_id, path FROM items WHERE contains(lower(path), 'urgent') AND contains(lower(path), '12')")
def _(items):
    return search.token_filter(items, "path", "URGENT  12").select("item_id", "path")


@query("j02_tags_per_item", "items", "item_tags", sql="""
SELECT i.item_id, coalesce(string_agg(tag, ',' ORDER BY score DESC, tag), '') AS tags FROM items i
LEFT JOIN (SELECT item_id, tag, max(score) AS score FROM item_tags GROUP BY item_id, tag) t ON i.item_id = t.item_id GROUP BY i.item_id""")
def _(items, item_tags):
    return search.tags_per_item(items, item_tags).select("item_id", joined("tags").alias("tags"))


@query("p02_item_profile", "items", "item_tags", "item_category", sql="""
SELECT i.item_id, i.path, coalesce(n_tags, 0) AS n_tags, best, category FROM items i
LEFT JOIN (SELECT item_id, count(DISTINCT tag) AS n_tags, round(max(score), 6) AS best FROM item_tags GROUP BY item_id) t ON i.item_id = t.item_id
LEFT JOIN item_category c ON i.item_id = c.item_id""")
def _(items, item_tags, item_category):
    found = search.item_profile(items, item_tags, item_category)
    return found.select("item_id", "path", F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)).cast("long").alias("n_tags"), F.round(F.get("tags", F.lit(0))["score"], 6).alias("best"), "category")


@query("a10_most_populated_model", "item_tags", sql="SELECT model_name, count(*) AS n FROM item_tags GROUP BY model_name ORDER BY n DESC, model_name LIMIT 1")
def _(item_tags):
    return search.most_populated(item_tags, "model_name")


@query("w02_nearest_members", "members", sql="""
SELECT cluster_no, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_no ORDER BY distance, item_id) AS rank FROM members) t WHERE rank <= 25""")
def _(members):
    return search.top_per_group(members, ["cluster_no"], ["distance", "item_id"], 25).select("cluster_no", "item_id", "rank")


@query("w03_fringe", "labelled", sql="""
SELECT label_user, region_id, run_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label_user ORDER BY distance DESC, region_id, run_id) AS rank FROM labelled WHERE label_user IS NOT NULL) t WHERE rank <= 10""")
def _(labelled):
    return search.top_per_group(labelled.where("label_user IS NOT NULL"), ["label_user"], [F.desc("distance"), "region_id", "run_id"], 10).select("label_user", "region_id", "run_id", "rank")


@query("w09_first_appearance", "labelled", "regions", sql="""
SELECT label_user, item_id, min(rank) AS rank FROM (
  SELECT l.label_user, r.item_id, row_number() OVER (PARTITION BY label_user ORDER BY distance, l.region_id, run_id) AS rank FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE label_user IS NOT NULL) t
WHERE rank <= 60 GROUP BY label_user, item_id""")
def _(labelled, regions):
    ranked = search.top_per_group(labelled.where("label_user IS NOT NULL").join(regions.select("region_id", "item_id"), "region_id"), ["label_user"], ["distance", "region_id", "run_id"], 60)
    return search.first_appearance(ranked, ["label_user"], "item_id")


@query("u04_categories_for_items", "item_tags", "members", "tag_category", "cluster_category", "item_category", sql="""
WITH rules AS (
  SELECT DISTINCT t.item_id, c.category FROM item_tags t JOIN tag_category c ON t.tag = c.tag
  UNION SELECT m.item_id, c.category FROM members m JOIN cluster_category c ON m.cluster_id = c.cluster_id)
SELECT item_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (
  SELECT * FROM rules WHERE item_id NOT IN (SELECT item_id FROM item_category) UNION ALL SELECT item_id, category FROM item_category) t GROUP BY item_id""")
def _(item_tags, members, tag_category, cluster_category, item_category):
    return search.categories_for_items(item_tags, members, tag_category, cluster_category, item_category).select("item_id", joined("categories").alias("categories"))


@query("a21_category_counts", "region", "tag_category", "cluster_category", sql="""
SELECT category, CAST(sum(is_tag) AS BIGINT) AS n_tags, CAST(sum(is_cluster) AS BIGINT) AS n_clusters FROM (
  SELECT r_name AS category, 0 AS is_tag, 0 AS is_cluster FROM region UNION ALL SELECT category, 1, 0 FROM tag_category UNION ALL SELECT category, 0, 1 FROM cluster_category) t GROUP BY category""")
def _(region, tag_category, cluster_category):
    return rules.category_counts(region.select(F.col("r_name").alias("category")), tag_category, cluster_category)


@query("j18_list_rules", "tag_category", "cluster_category", "item_category", sql="""
SELECT 'tag' AS layer, tag AS target, category FROM tag_category UNION ALL SELECT 'cluster', CAST(cluster_id AS VARCHAR), category FROM cluster_category
UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), category FROM item_category""")
def _(tag_category, cluster_category, item_category):
    return rules.list_rules(tag_category, cluster_category, item_category)


@query("j18_add_rules_rejected", "tag_category", "region", "nation", sql="""
SELECT n_name AS tag, 'ASIA' AS category, 'unknown target' AS reason FROM nation UNION ALL SELECT tag, 'NOWHERE', 'unknown category' FROM tag_category""")
def _(tag_category, region, nation):
    new = nation.select(F.col("n_name").alias("tag"), F.lit("ASIA").alias("category")).union(tag_category.select("tag", F.lit("NOWHERE")))
    return rules.add_rules(tag_category, new, tag_category, region.select(F.col("r_name").alias("category")))[1]


# --- regions and people


@query("w01_latest_assignment", "labelled", sql="SELECT region_id, run_id, cluster_id, label_user FROM latest")
def _(labelled):
    return people.latest_assignment(labelled).select("region_id", "run_id", "cluster_id", "label_user")


@query("w01_attach_similarity", "labelled", sql="SELECT region_id, CASE WHEN run_id = 2 THEN round(least(greatest(1 - distance, 0.0), 1.0), 6) END AS attach_sim FROM latest")
def _(labelled):
    return people.latest_assignment(labelled).select("region_id", F.round(people.attach_similarity(F.col("distance"), F.col("run_id") == 2), 6).alias("attach_sim"))


@query("j05_unidentified", "regions", "labelled", sql="SELECT region_id, item_id FROM regions WHERE region_id NOT IN (SELECT region_id FROM labelled WHERE label_user IS NOT NULL)")
def _(regions, labelled):
    return people.unidentified(regions, labelled).select("region_id", "item_id")


@query("a07_unidentified_per_item", "regions", "labelled", sql="SELECT item_id, count(*) AS n FROM regions WHERE region_id NOT IN (SELECT region_id FROM labelled WHERE label_user IS NOT NULL) GROUP BY item_id")
def _(regions, labelled):
    return people.items_with_regions(people.unidentified(regions, labelled))


@query("j06_named_unvalidated", "regions", "labelled", sql="SELECT region_id FROM regions WHERE coalesce(user_verified, 0) = 0 AND region_id IN (SELECT region_id FROM labelled WHERE label_user IS NOT NULL)")
def _(regions, labelled):
    return people.named_unvalidated(regions, labelled).select("region_id")


@query("p10_validated", "regions", sql="SELECT region_id, item_id FROM regions WHERE coalesce(user_verified, 0) = 1")
def _(regions):
    return people.validated(regions).select("region_id", "item_id")


@query("p09_verify_regions", "regions", sql="""
SELECT count(*) AS n_checked, count(*) FILTER (NOT (det_score < 0.65 OR w * h < 1024)) AS n_kept, count(*) FILTER (det_score < 0.65) AS n_low_score,
       count(*) FILTER (w * h < 1024) AS n_small, 0::BIGINT AS n_skipped, count(*) FILTER (det_score < 0.65 OR w * h < 1024) AS n_rejected FROM regions""")
def _(regions):
    return people.verify_counts(people.verify_regions(regions))


@query("f13_suspects", "regions", sql="SELECT region_id FROM regions WHERE coalesce(user_verified = 0, false) OR det_score < 0.65")
def _(regions):
    return regions.where(X.suspect(F.col("user_verified"), F.col("det_score"))).select("region_id")


@query("j07_duplicates_to_drop", "labelled", "regions", sql="""
WITH open AS (SELECT l.region_id, r.item_id, l.label_user FROM latest l JOIN regions r ON l.region_id = r.region_id WHERE coalesce(user_verified, 0) = 0),
keep AS (SELECT item_id, label_user, min(region_id) AS keep_id FROM open WHERE label_user IS NOT NULL GROUP BY item_id, label_user)
SELECT o.region_id FROM open o JOIN keep k ON o.item_id = k.item_id AND o.label_user = k.label_user WHERE o.region_id <> keep_id""")
def _(labelled, regions):
    open_ = people.latest_assignment(labelled).join(people.validated(regions, False).select("region_id", "item_id"), "region_id").where("label_user IS NOT NULL")
    keep = open_.groupBy("item_id", F.col("label_user").alias("label")).agg(F.min("region_id").alias("region_id"))
    return people.duplicates_to_drop(labelled, regions, keep)


@query("a08_triage_queue", "labelled", "regions", sql="""
SELECT item_id, CAST(sum(n) AS BIGINT) AS n_unverified, count(*) FILTER (n >= 2) AS n_dups, CAST(sum(n) + 2 * count(*) FILTER (n >= 2) AS BIGINT) AS score FROM (
  SELECT r.item_id, l.label_user, count(*) AS n FROM latest l JOIN regions r ON l.region_id = r.region_id WHERE label_user IS NOT NULL AND coalesce(user_verified, 0) = 0 GROUP BY r.item_id, l.label_user) t
GROUP BY item_id""")
def _(labelled, regions):
    return people.triage_queue(labelled, regions)


@query("a09_duplicate_names", "labelled", "regions", sql="SELECT item_id, label_user, count(*) AS n FROM latest l JOIN regions r ON l.region_id = r.region_id WHERE label_user IS NOT NULL GROUP BY item_id, label_user HAVING count(*) > 1")
def _(labelled, regions):
    return people.duplicate_names(labelled, regions)


@query("a05_named_people", "labelled", "regions", sql="SELECT label_user, count(DISTINCT item_id) AS n_items, count(DISTINCT cluster_id) AS n_clusters FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE label_user IS NOT NULL GROUP BY label_user")
def _(labelled, regions):
    return people.named_people(labelled, regions)


@query("a22_person_view", "labelled", "regions", sql="SELECT label_user, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT item_id) AS n_items, count(DISTINCT l.region_id) AS n_regions FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE label_user IS NOT NULL GROUP BY label_user")
def _(labelled, regions):
    return people.person_view(labelled, regions)


@query("a06_region_summary", "regions", sql="SELECT count(*) AS n_regions, count(DISTINCT item_id) AS n_items FROM regions")
def _(regions):
    return people.region_summary(regions)


@query("a07_items_with_regions", "regions", sql="SELECT item_id, count(*) AS n FROM regions GROUP BY item_id")
def _(regions):
    return people.items_with_regions(regions)


@query("a04_run_summary", "clusters", sql="""
SELECT run_id, count(*) FILTER (cluster_no <> -1) AS n_clusters, CAST(coalesce(sum(size) FILTER (cluster_no = -1), 0) AS BIGINT) AS n_noise, CAST(sum(size) AS BIGINT) AS total FROM clusters GROUP BY run_id""")
def _(clusters):
    return people.run_summary(clusters)


@query("p06_unnamed_clusters", "clusters", sql="SELECT cluster_id, size FROM clusters WHERE run_id = 1 AND label_user IS NULL AND cluster_no <> -1")
def _(clusters):
    return people.unnamed_clusters(clusters, 1).select("cluster_id", "size")


@query("p07_cluster_order", "clusters", sql="SELECT cluster_id, (label_user IS NULL) AS unnamed, size, lag(cluster_id) OVER (PARTITION BY label_user IS NULL ORDER BY size DESC, cluster_id) AS before FROM clusters")
def _(clusters):
    listed = people.cluster_order(clusters).withColumns({"unnamed": F.col("label_user").isNull(), "at": F.monotonically_increasing_id()})
    return listed.withColumn("before", F.lag("cluster_id").over(W.partitionBy("unnamed").orderBy("at"))).select("cluster_id", "unnamed", "size", "before")


@query("w05_split_label", "clusters", sql="""
SELECT cluster_id, concat(label_user, ' ', CAST(row_number() OVER (PARTITION BY label_user ORDER BY size DESC, cluster_id) AS VARCHAR)) AS new_label FROM clusters
WHERE cluster_no <> -1 AND label_user = (SELECT min(label_user) FROM clusters)""")
def _(clusters):
    return people.split_label(clusters, clusters.agg(F.min("label_user")).first()[0]).select("cluster_id", "new_label")


@query("w06_allocate_numbers", "clusters", "identities", sql="""
SELECT name, (SELECT max(cluster_no) FROM clusters WHERE run_id = 1) + row_number() OVER (ORDER BY name) AS cluster_no FROM identities""")
def _(clusters, identities):
    return tables.allocate(identities.withColumn("run_id", F.lit(1)), clusters, "cluster_no", ["run_id"], ["name"]).select("name", F.col("cluster_no").cast("long").alias("cluster_no"))


@query("w07_latest_run", "clusters", sql="SELECT max(run_id) AS run_id FROM clusters")
def _(clusters):
    return people.latest_run(clusters)


# --- the correction log


@query("p05_corrections", "corrections", sql="SELECT id, region_id, action, name FROM corrections WHERE action IN ('named', 'deleted') AND region_id = 42")
def _(corrections):
    return feedback.corrections(corrections, ["named", "deleted"], 42).select("id", "region_id", "action", "name")


@query("a14_compact_log", "corrections", sql="""
SELECT id, region_id, action FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(region_id, -1), action ORDER BY id DESC) AS rn FROM corrections) t WHERE rn = 1 OR action = 'unassigned'""")
def _(corrections):
    return feedback.compact_log(corrections).select("id", "region_id", "action")


@query("j08_cannot_link", "corrections", "clusters", sql="""
SELECT DISTINCT l.region_id, c.label_user AS label FROM corrections l JOIN clusters c ON l.cluster_id = c.cluster_id WHERE action = 'unassigned' AND label_user IS NOT NULL""")
def _(corrections, clusters):
    return feedback.cannot_link(corrections, clusters)


_INTENT = "intent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY id DESC) AS rn FROM corrections WHERE action IN ('named', 'unassigned')) t WHERE rn = 1)"


@query("w08_latest_intent", "corrections", sql=f"WITH {_INTENT} SELECT region_id, id, action, name FROM intent")
def _(corrections):
    return feedback.latest_intent(corrections).select("region_id", "id", "action", "name")


@query("j16_must_links", "corrections", sql=f"""
WITH {_INTENT}, named AS (SELECT region_id, min(region_id) OVER (PARTITION BY name) AS src FROM intent WHERE action = 'named')
SELECT src, region_id AS dst FROM named WHERE src <> region_id""")
def _(corrections):
    return feedback.must_links(corrections)


@query("j17_cannot_links", "corrections", "clusters", sql=f"""
WITH {_INTENT}, gone AS (SELECT DISTINCT l.region_id, c.label_user AS label FROM corrections l JOIN clusters c ON l.cluster_id = c.cluster_id WHERE action = 'unassigned' AND label_user IS NOT NULL)
SELECT DISTINCT g.region_id AS src, i.region_id AS dst FROM gone g JOIN intent i ON i.name = g.label AND i.action = 'named' WHERE g.region_id <> i.region_id""")
def _(corrections, clusters):
    return feedback.cannot_links(corrections, clusters)


@query("v14_replay_assignments", "corrections", "assignments", "clusters", sql=f"""
WITH {_INTENT}
SELECT a.region_id, CASE WHEN i.action = 'unassigned' THEN -1 ELSE cluster_no END AS cluster_no FROM assignments a LEFT JOIN intent i ON a.region_id = i.region_id WHERE run_id = 2""")
def _(corrections, assignments, clusters):
    return feedback.replay_corrections(corrections, assignments, clusters, 2)[0].select("region_id", "cluster_no")


@query("v14_replay_labels", "corrections", "assignments", "clusters", sql=f"""
WITH {_INTENT}, labels AS (SELECT cluster_no, arg_min(name, id) AS name FROM assignments a JOIN intent i ON a.region_id = i.region_id WHERE run_id = 2 AND action = 'named' AND cluster_no <> -1 GROUP BY cluster_no)
SELECT c.cluster_id, coalesce(l.name, c.label_user) AS label_user FROM clusters c LEFT JOIN labels l ON c.cluster_no = l.cluster_no WHERE run_id = 2""")
def _(corrections, assignments, clusters):
    return feedback.replay_corrections(corrections, assignments, clusters, 2)[1].select("cluster_id", "label_user")


@query("v20_apply_actions", "regions", "corrections", sql="""
WITH last AS (SELECT region_id, arg_max(action, id) AS action FROM corrections WHERE action IN ('verified', 'unverified', 'named') GROUP BY region_id)
SELECT r.region_id, CASE WHEN c.action IS NULL THEN r.user_verified WHEN c.action <> 'unverified' THEN 1 END AS user_verified FROM regions r
LEFT JOIN last c ON r.region_id = c.region_id WHERE r.region_id NOT IN (SELECT region_id FROM corrections WHERE action = 'deleted')""")
def _(regions, corrections):
    return feedback.apply_actions(regions, corrections)["regions"].select("region_id", "user_verified")


@query("v20_audit_rows", "regions", "corrections", sql="""
SELECT c.id, r.region_id, r.item_id, c.action, c.cluster_id, c.name FROM corrections c JOIN regions r ON r.region_id = c.region_id""")
def _(regions, corrections):
    return feedback.apply_actions(regions, corrections)["log"]


@query("v19_unassign", "assignments", "corrections", sql="""
SELECT region_id, run_id, cluster_no FROM assignments WHERE NOT (run_id = 2 AND region_id IN (SELECT region_id FROM corrections WHERE action = 'deleted'))""")
def _(assignments, corrections):
    return feedback.unassign(assignments, corrections.where("action = 'deleted'").select("region_id").distinct(), 2)[0].select("region_id", "run_id", "cluster_no")


@query("v19_detach_from_noise", "assignments", "corrections", sql="""
SELECT region_id, run_id, cluster_no FROM assignments WHERE NOT (cluster_no = -1 AND region_id IN (SELECT region_id FROM corrections WHERE action = 'named'))""")
def _(assignments, corrections):
    return feedback.detach_from_noise(assignments, corrections.where("action = 'named'").select("region_id").distinct()).select("region_id", "run_id", "cluster_no")


@query("v16_rename_label", "clusters", "identities", sql="SELECT c.cluster_id, CASE WHEN i.name IS NOT NULL AND c.cluster_no <> -1 THEN lower(i.name) ELSE c.label_user END AS label_user FROM clusters c LEFT JOIN identities i ON c.label_user = i.name")
def _(clusters, identities):
    return feedback.rename_label(clusters, identities.select(F.col("name").alias("old"), F.lower("name").alias("new"))).select("cluster_id", "label_user")


_MAPPING = "SELECT CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE CAST(1000 + n_nationkey AS VARCHAR) END AS key, n_name AS value FROM nation"


@query("s15_rename_bulk_rejected", "nation", "clusters", sql=f"""
SELECT key, CASE WHEN try_cast(key AS BIGINT) IS NULL THEN 'not a number' WHEN c.cluster_id IS NULL THEN 'unknown cluster' ELSE 'noise' END AS reason
FROM ({_MAPPING}) m LEFT JOIN clusters c ON try_cast(key AS BIGINT) = c.cluster_id WHERE c.cluster_id IS NULL OR c.cluster_no = -1""")
def _(nation, clusters):
    mapping = nation.selectExpr("CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE CAST(1000 + n_nationkey AS STRING) END AS key", "n_name AS value")
    return feedback.rename_bulk(clusters, mapping)[1]


@query("v18_clear_noise_labels", "clusters", sql="SELECT cluster_id, CASE WHEN cluster_no <> -1 THEN label_user END AS label_user FROM clusters")
def _(clusters):
    return feedback.clear_noise_labels(clusters).select("cluster_id", "label_user")


# --- audits


@query("a11_size_audit", "assignments", "clusters", sql="""
SELECT c.cluster_id, c.size, coalesce(n, 0) AS actual FROM clusters c LEFT JOIN (SELECT run_id, cluster_no, count(*) AS n FROM assignments GROUP BY run_id, cluster_no) a ON c.run_id = a.run_id AND c.cluster_no = a.cluster_no WHERE coalesce(n, 0) <> c.size""")
def _(assignments, clusters):
    return audit.size_audit(assignments, clusters).select("cluster_id", "size", "actual")


@query("a11_fix_sizes", "assignments", "clusters", sql="SELECT run_id * 1000 + cluster_no + 1 AS cluster_id, count(*) AS size FROM assignments GROUP BY run_id, cluster_no")
def _(assignments, clusters):
    return audit.fix_sizes(assignments, clusters).select("cluster_id", "size")


@query("a12_catalog_audit", "assignments", "clusters", "vectors", "identities", sql="""
SELECT 'size' AS "check", CAST(c.cluster_id AS VARCHAR) AS key, concat(CAST(c.size AS VARCHAR), ' recorded, ', CAST(n AS VARCHAR), ' there') AS detail
FROM clusters c JOIN (SELECT run_id, cluster_no, count(*) AS n FROM assignments GROUP BY run_id, cluster_no) a ON c.run_id = a.run_id AND c.cluster_no = a.cluster_no WHERE n <> c.size
UNION ALL SELECT 'identity', name, 'no cluster' FROM identities WHERE name NOT IN (SELECT label_user FROM clusters WHERE label_user IS NOT NULL)
UNION ALL SELECT 'vector', CAST(vec_id AS VARCHAR), 'missing' FROM vectors WHERE embedding IS NULL OR len(embedding) = 0""")
def _(assignments, clusters, vectors, identities):
    return audit.catalog_audit(assignments, clusters, vectors, identities)


@query("j09_orphan_identities", "identities", "clusters", sql="SELECT name FROM identities WHERE name NOT IN (SELECT label_user FROM clusters WHERE label_user IS NOT NULL)")
def _(identities, clusters):
    return audit.orphan_identities(identities, clusters)


@query("a13_region_stats", "regions", sql="""
SELECT count(*) AS n_regions, count(*) FILTER (user_verified = 1) AS n_verified, count(*) FILTER (user_verified = 0) AS n_unverified, count(*) FILTER (user_verified IS NULL) AS n_open, count(DISTINCT item_id) AS n_items FROM regions""")
def _(regions):
    return audit.region_stats(regions)


@query("f18_identity_thresholds", "labelled", sql="""
WITH s AS (SELECT label_user AS name, count(*) AS n, avg(1 - distance) AS mean, stddev_samp(1 - distance) AS sd FROM labelled WHERE label_user IS NOT NULL GROUP BY label_user)
SELECT name, n, round(CASE WHEN n >= 5 AND sd > 0 THEN least(0.95, greatest(0.7, 0.7 + 2 * sd)) ELSE 0.7 END, 6) AS threshold FROM s""")
def _(labelled):
    sims = labelled.where("label_user IS NOT NULL").select(F.col("label_user").alias("name"), (1 - F.col("distance")).alias("sim"))
    return audit.identity_thresholds(vectors.running_stats(sims, "name", "sim")).select("name", "n", r6("threshold"))


@query("a17_running_stats", "labelled", sql="SELECT label_user AS name, count(*) AS n, round(avg(1 - distance), 6) AS mean, round(var_pop(1 - distance) * count(*), 4) AS m2 FROM labelled WHERE label_user IS NOT NULL GROUP BY label_user")
def _(labelled):
    sims = labelled.where("label_user IS NOT NULL").select(F.col("label_user").alias("name"), (1 - F.col("distance")).alias("sim"))
    return vectors.running_stats(sims, "name", "sim").select("name", "n", r6("mean"), F.round("m2", 4).alias("m2"))


# --- sources, writes, exports


@query("s03_classify_changes", "items", sql="""
SELECT CASE WHEN item_id % 50 = 0 THEN 'missing' WHEN item_id % 7 = 0 THEN CASE WHEN item_id % 3 = 0 THEN 'unchanged' ELSE 'changed' END ELSE 'unchanged' END AS status, count(*) AS n FROM items GROUP BY 1
UNION ALL SELECT 'new', count(*) FROM items WHERE item_id % 11 = 0""")
def _(items):
    catalog = items.select("path", "mtime", "hash")
    listed = items.where("item_id % 50 <> 0").select("path", F.when(F.col("item_id") % 7 == 0, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime")).alias("mtime"))
    extra = items.where("item_id % 11 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "mtime")
    hashes = items.where("item_id % 7 = 0").select("path", F.when(F.col("item_id") % 3 == 0, F.col("hash")).otherwise(F.md5("hash")).alias("hash"))
    return files.ingest_counts(files.classify_changes(listed.union(extra), catalog, hashes))


@query("s04_detect_moves", "items", sql="""
WITH gone AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM items WHERE item_id % 5 = 0),
come AS (SELECT hash, concat('moved/', path) AS path, row_number() OVER (PARTITION BY hash ORDER BY concat('moved/', path)) AS n FROM items WHERE item_id % 4 = 0)
SELECT g.path AS from_path, c.path AS to_path, g.hash FROM gone g JOIN come c ON g.hash = c.hash AND g.n = c.n""")
def _(items):
    return files.detect_moves(items.where("item_id % 4 = 0").select(F.concat(F.lit("moved/"), "path").alias("path"), "hash"), items.where("item_id % 5 = 0"))


@query("s05_prune", "items", sql="SELECT item_id, path FROM items WHERE item_id % 13 = 0")
def _(items):
    return files.prune(items, items.where("item_id % 13 <> 0")).select("item_id", "path")


@query("s08_upsert", "items", sql="""
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'new' ELSE hash END AS hash FROM items UNION ALL SELECT item_id + 100000000, 'new' FROM items WHERE item_id % 9 = 0""")
def _(items):
    delta = items.where("item_id % 3 = 0").select("item_id", F.lit("new").alias("hash")).union(items.where("item_id % 9 = 0").select(F.col("item_id") + 100000000, F.lit("new")))
    return tables.upsert(items.select("item_id", "hash"), delta, ["item_id"])


@query("s09_replace_slice", "item_tags", sql="""
SELECT item_id, tag, model_name, score FROM item_tags t WHERE NOT EXISTS (SELECT 1 FROM item_tags d WHERE d.item_id = t.item_id AND d.model_name = t.model_name AND d.item_id % 10 = 0 AND d.model_name = 'tagger_A')
UNION ALL SELECT item_id, 'fresh', model_name, 1.0 FROM (SELECT DISTINCT item_id, model_name FROM item_tags WHERE item_id % 10 = 0 AND model_name = 'tagger_A') x""")
def _(item_tags):
    base = item_tags.select("item_id", "tag", "model_name", "score")
    delta = base.where("item_id % 10 = 0 AND model_name = 'tagger_A'").select("item_id", F.lit("fresh").alias("tag"), "model_name", F.lit(1.0).alias("score")).distinct()
    return tables.replace_slice(base, delta, ["item_id", "model_name"])


@query("s10_cascade_delete", "items", "item_tags", "regions", "assignments", sql="""
SELECT 'items' AS name, count(*) AS n FROM items WHERE item_id % 10 <> 0 UNION ALL SELECT 'item_tags', count(*) FROM item_tags WHERE item_id % 10 <> 0 OR item_id NOT IN (SELECT item_id FROM items)
UNION ALL SELECT 'regions', count(*) FROM regions WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 10 = 0)
UNION ALL SELECT 'assignments', count(*) FROM assignments WHERE region_id NOT IN (SELECT region_id FROM regions WHERE item_id IN (SELECT item_id FROM items WHERE item_id % 10 = 0))""")
def _(items, item_tags, regions, assignments):
    left = tables.cascade_delete({"items": items, "item_tags": item_tags, "regions": regions, "assignments": assignments}, "items", items.where("item_id % 10 = 0").select("item_id"))
    return tables.union_all([t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in left.items()])


@query("s12_export_rows", "items", "item_tags", sql="""
SELECT i.item_id, coalesce(string_agg(concat(tag, '=', CAST(round(score, 2) AS VARCHAR)), ',' ORDER BY score DESC, tag) FILTER (tag IS NOT NULL), '') AS tags FROM items i
LEFT JOIN (SELECT item_id, tag, max(score) AS score FROM item_tags WHERE score >= 0.5 GROUP BY item_id, tag) t ON i.item_id = t.item_id GROUP BY i.item_id""")
def _(items, item_tags):
    return export.export_rows(items, item_tags, 0.5).select("item_id", joined(F.transform("tags", lambda x: F.concat(x["name"], F.lit("="), F.round(x["score"], 2).cast("string")))).alias("tags"))


@query("s13_csv_rows", "items", "item_tags", sql="""
SELECT i.item_id, i.path, coalesce(string_agg(printf('%s:%.2f', tag, score), ',' ORDER BY score DESC, tag), '') AS tags FROM items i
LEFT JOIN (SELECT item_id, tag, max(score) AS score FROM item_tags WHERE score >= 0.5 GROUP BY item_id, tag) t ON i.item_id = t.item_id GROUP BY i.item_id, i.path""")
def _(items, item_tags):
    return export.csv_rows(items, item_tags, 0.5)


@query("s14_tsv_lines", "items", "item_tags", sql="""
SELECT printf('%d\t%.3f\t%s', t.item_id, avg(score), any_value(path)) AS value FROM item_tags t JOIN items i ON t.item_id = i.item_id
WHERE tag = 'Brand#3' AND score >= 0.9 GROUP BY t.item_id""")
def _(items, item_tags):
    return export.tsv_lines(search.search_by_all_tags(item_tags, items, ["Brand#3"], 0.9))


@query("s16_report", "members", "items", sql="""
SELECT cluster_no, count(*) AS n, count(*) FILTER (rank <= 25) AS n_nearest, max(CASE WHEN rank = 1 THEN substring(sha256(path), 1, 16) END) AS first_thumb FROM (
  SELECT m.cluster_no, i.path, row_number() OVER (PARTITION BY cluster_no ORDER BY distance, path) AS rank FROM members m JOIN items i ON m.item_id = i.item_id) t GROUP BY cluster_no""")
def _(members, items):
    found = export.report_dataset(members.join(items.select("item_id", "path"), "item_id"), members.select("cluster_no").distinct())
    return found.select("cluster_no", "n", F.size("nearest").cast("long").alias("n_nearest"), F.col("nearest")[0]["thumb"].alias("first_thumb"))


@query("s17_sidecar_plan", "items", "item_tags", "labelled", "regions", "item_category", sql="""
WITH subj AS (SELECT item_id, tag AS s FROM item_tags WHERE score >= 0.8 UNION SELECT r.item_id, l.label_user FROM latest l JOIN regions r ON l.region_id = r.region_id WHERE user_verified = 1 AND label_user IS NOT NULL)
SELECT i.item_id, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS subjects, coalesce(string_agg(DISTINCT concat(c.category, '|', s), ',' ORDER BY concat(c.category, '|', s)) FILTER (c.category IS NOT NULL AND s IS NOT NULL), '') AS hierarchical
FROM items i LEFT JOIN subj ON i.item_id = subj.item_id LEFT JOIN item_category c ON i.item_id = c.item_id GROUP BY i.item_id""")
def _(items, item_tags, labelled, regions, item_category):
    shown = people.latest_assignment(labelled).where("label_user IS NOT NULL").join(people.validated(regions).select("region_id", "item_id"), "region_id").select("item_id", F.col("label_user").alias("name"))
    cats = item_category.groupBy("item_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return export.sidecar_plan(items, item_tags, shown, cats, 0.8).select("item_id", joined("subjects").alias("subjects"), joined("hierarchical").alias("hierarchical"))


@query("s20_sidecar_candidates", "items", sql="SELECT item_id FROM items WHERE item_id % 6 = 0")
def _(items):
    return export.sidecar_candidates(items, items.where("item_id % 6 = 0").select(F.concat("path", F.lit(".xmp")).alias("path"))).select("item_id")


@query("x05_unscored", "items", "item_tags", sql="SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags WHERE model_name = 'tagger_R')")
def _(items, item_tags):
    from filmroll.functions.scoring import unscored

    return unscored(items, item_tags, "tagger_R").select("item_id")


@query("f14_thumb_key", "items", sql="SELECT item_id, concat(substring(sha256(path), 1, 16), '.jpg') AS thumb FROM items")
def _(items):
    return items.select("item_id", X.thumb_key(F.col("path")).alias("thumb"))


@query("f15_relative_path", "items", sql="SELECT item_id, CASE WHEN starts_with(path, '1-URGENT/') THEN substring(path, 10) ELSE path END AS rel FROM items")
def _(items):
    return items.select("item_id", X.relative_path(F.col("path"), "1-URGENT/").alias("rel"))


@query("f16_display_label", "clusters", sql="SELECT cluster_id, coalesce(label_user, concat('cluster ', CAST(cluster_no AS VARCHAR))) AS label FROM clusters")
def _(clusters):
    return clusters.select("cluster_id", X.display_label(F.col("label_user"), F.concat(F.lit("cluster "), F.col("cluster_no").cast("string"))).alias("label"))


# --- places


_KM = "2 * 6371.0 * asin(least(sqrt(pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lon) - radians(p.lon)) / 2), 2)), 1.0))"
_NEAREST = f"near AS (SELECT p.item_id, arg_min(q.place_id, {_KM}) AS place_id, min({_KM}) AS km FROM points p CROSS JOIN places q GROUP BY p.item_id)"


@query("j12_nearest_place", "points", "places", sql=f"WITH {_NEAREST} SELECT item_id, place_id, round(km, 3) AS km FROM near")
def _(points, gazetteer):
    return places.nearest_place(points, gazetteer).select("item_id", "place_id", F.round("km", 3).alias("km"))


@query("j12_nearest_place_by_cell", "points", "places", sql=f"WITH {_NEAREST} SELECT item_id, place_id, round(km, 3) AS km FROM near")
def _(points, gazetteer):
    return places.nearest_place(points, gazetteer, at_most=0).select("item_id", "place_id", F.round("km", 3).alias("km"))


@query("j13_geo_tags", "points", "places", "item_tags", sql=f"""
WITH {_NEAREST}, todo AS (SELECT n.item_id, lower(p.city) AS city, lower(p.country) AS country FROM near n JOIN places p ON n.place_id = p.place_id WHERE n.item_id NOT IN (SELECT item_id FROM item_tags WHERE model_name = 'geo_v1'))
SELECT item_id, city AS tag, 1.0::DOUBLE AS score FROM todo UNION ALL SELECT item_id, country, 1.0::DOUBLE FROM todo WHERE country <> city""")
def _(points, gazetteer, item_tags):
    return places.geo_tags(points, places.nearest_place(points, gazetteer), gazetteer, item_tags).select("item_id", "tag", "score")


# --- vectors and clusters

_CENTROIDS = "cent AS (SELECT label, list(x ORDER BY pos) AS centroid, max(n) AS n FROM (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM vectors) e GROUP BY label, pos) s GROUP BY label)"
_SIMS = "sims AS (SELECT v.vec_id, c.label AS name, list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) AS sim, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) DESC, CAST(c.label AS VARCHAR)) AS rank FROM vectors v CROSS JOIN cent c)"
_TOP2 = "top2 AS (SELECT a.vec_id AS region_id, CAST(a.name AS VARCHAR) AS name, a.sim, b.sim AS second FROM sims a LEFT JOIN sims b ON a.vec_id = b.vec_id AND b.rank = 2 WHERE a.rank = 1)"


def _identities(v: DataFrame) -> DataFrame:
    means = vectors.centroids(v, "label")
    zero = F.lit(0.0)
    return means.select(F.col("label").cast("string").alias("name"), "centroid", F.col("n").alias("n_samples"), F.lit(0).cast("long").alias("sim_n"), zero.alias("sim_mean"), zero.alias("sim_m2"))


def _regions_of(v: DataFrame) -> DataFrame:
    return v.select(F.col("vec_id").alias("region_id"), "embedding")


@query("a15_centroids", "vectors", sql=f"WITH {_CENTROIDS} SELECT label, n, round(list_sum(centroid), 5) AS total, round(centroid[1], 5) AS first FROM cent")
def _(v):
    return vectors.centroids(v, "label").select("label", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.col("centroid")[0], 5).alias("first"))


@query("v01_vector_search", "vectors", sql="SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS sim FROM vectors v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC LIMIT 20")
def _(v):
    return search.vector_search(v, v.where("vec_id = 7").first()["embedding"], 20).select("vec_id", F.round("sim", 5).alias("sim"))


@query("v01_batch_search", "vectors", sql="""
SELECT query_id, vec_id, round(sim, 4) AS sim, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM vectors q CROSS JOIN vectors v WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def _(v):
    index = vector_index.build_index(v, 64)
    return vector_index.batch_search(index, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10).withColumn("sim", F.round("sim", 4))


@query("v01_filtered_search", "vectors", sql="SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS sim FROM vectors v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE v.vec_id % 3 = 0 ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC LIMIT 20")
def _(v):
    return search.vector_search(v, v.where("vec_id = 7").first()["embedding"], 20, allowed=v.where("vec_id % 3 = 0")).select("vec_id", F.round("sim", 5).alias("sim"))


@query("j11_top2", "vectors", sql=f"WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT region_id, name, round(sim, 5) AS sim, round(second, 5) AS second FROM top2")
def _(v):
    return vectors.top2(_regions_of(v), _identities(v)).select("region_id", "name", F.round("sim", 5).alias("sim"), F.round("second", 5).alias("second"))


_STATUS = "CASE WHEN sim < 0.1 THEN 'below' WHEN sim - second < 0.02 THEN 'ambiguous' ELSE 'matched' END"


@query("v04_auto_attach", "vectors", sql=f"WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT region_id, name, {_STATUS} AS status, {_STATUS} = 'matched' AND sim >= 0.3 AS validated FROM top2")
def _(v):
    return vectors.auto_attach(_regions_of(v), _identities(v), 0.1, 0.02, 0.3).select("region_id", "name", "status", "validated")


@query("a18_attach_histogram", "vectors", sql=f"""
WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT name, count(*) AS n, count(*) FILTER (sim >= 0.3) AS n_validated, round(min(sim), 5) AS min_sim, round(max(sim), 5) AS max_sim FROM top2 WHERE {_STATUS} = 'matched' GROUP BY name""")
def _(v):
    found = vectors.attach_histogram(vectors.auto_attach(_regions_of(v), _identities(v), 0.1, 0.02, 0.3))
    return found.select("name", "n", "n_validated", F.round("min_sim", 5).alias("min_sim"), F.round("max_sim", 5).alias("max_sim"))


@query("v05_persist_attach", "vectors", sql=f"""
WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT t.name, any_value(c.n) + count(*) AS n_samples, count(*) AS sim_n, round(avg(sim), 5) AS sim_mean FROM top2 t JOIN cent c ON t.name = CAST(c.label AS VARCHAR) WHERE {_STATUS} = 'matched' GROUP BY t.name""")
def _(v):
    found = vectors.auto_attach(_regions_of(v), _identities(v), 0.1, 0.02, 0.3)
    return vectors.persist_attach(found, _regions_of(v), _identities(v), 3)["identities"].select("name", "n_samples", "sim_n", F.round("sim_mean", 5).alias("sim_mean"))


@query("v02_suggest", "vectors", sql=f"WITH {_CENTROIDS}, {_SIMS} SELECT vec_id AS region_id, CAST(name AS VARCHAR) AS name, rank, round(sim, 5) AS sim FROM sims WHERE rank <= 3")
def _(v):
    return vectors.suggest(_regions_of(v), _identities(v), 3).select("region_id", "name", "rank", F.round("sim", 5).alias("sim"))


@query("a19_tfidf_labels", "members", "item_tags", sql="""
WITH tf AS (SELECT cluster_no, tag, count(*) AS tf FROM members m JOIN item_tags t ON m.item_id = t.item_id WHERE cluster_no <> -1 GROUP BY cluster_no, tag),
df AS (SELECT tag, count(*) AS df FROM tf GROUP BY tag), n AS (SELECT count(DISTINCT cluster_no) AS n FROM members WHERE cluster_no <> -1),
best AS (SELECT cluster_no, tf.tag, row_number() OVER (PARTITION BY cluster_no ORDER BY tf * (ln((n + 1) / (df + 1)) + 1) DESC, tf.tag) AS k FROM tf JOIN df ON tf.tag = df.tag CROSS JOIN n)
SELECT cluster_no, string_agg(tag, ', ' ORDER BY k) AS label_auto FROM best WHERE k <= 5 GROUP BY cluster_no UNION ALL SELECT -1, 'noise'""")
def _(members, item_tags):
    return clustering.tfidf_labels(members.join(item_tags, "item_id").select("cluster_no", "tag"), members)


@query("a20_freq_labels", "members", "item_tags", sql="""
WITH best AS (SELECT cluster_no, tag, row_number() OVER (PARTITION BY cluster_no ORDER BY count(*) DESC, tag) AS k FROM members m JOIN item_tags t ON m.item_id = t.item_id GROUP BY cluster_no, tag)
SELECT cluster_no, CASE WHEN cluster_no = -1 THEN 'noise' ELSE string_agg(tag, ', ' ORDER BY k) END AS label_auto FROM best WHERE k <= 5 GROUP BY cluster_no""")
def _(members, item_tags):
    return clustering.freq_labels(members.join(item_tags, "item_id").select("cluster_no", "tag"))


@query("a03_cluster_top_tags", "members", "item_tags", sql="""
SELECT * FROM (SELECT cluster_no, tag, count(*) AS n, row_number() OVER (PARTITION BY cluster_no ORDER BY count(*) DESC, tag) AS rank FROM members m JOIN item_tags t ON m.item_id = t.item_id GROUP BY cluster_no, tag) x WHERE rank <= 10""")
def _(members, item_tags):
    return clustering.cluster_top_tags(members.join(item_tags, "item_id"), 10)


@query("v22_run_diff", "assignments", sql="""
WITH a AS (SELECT * FROM assignments WHERE run_id = 1), b AS (SELECT * FROM assignments WHERE run_id = 2),
c AS (SELECT a.cluster_no AS a_no, b.cluster_no AS b_no, count(*) AS common FROM a JOIN b ON a.region_id = b.region_id GROUP BY 1, 2),
j AS (SELECT a_no, b_no, common, common / (na + nb - common) AS jaccard FROM c JOIN (SELECT cluster_no, count(*) AS na FROM a GROUP BY 1) x ON a_no = x.cluster_no JOIN (SELECT cluster_no, count(*) AS nb FROM b GROUP BY 1) y ON b_no = y.cluster_no)
SELECT a_no, b_no, common, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a_no ORDER BY jaccard DESC, b_no) AS k FROM j) t WHERE k = 1""")
def _(assignments):
    return clustering.run_diff(assignments.where("run_id = 1"), assignments.where("run_id = 2")).select("a_no", "b_no", "common", r6("jaccard"))


@query("v07_reduce_dims", "vectors")
def _(v):
    return clustering.reduce_dims(v, 8).select("vec_id", F.round(X.norm(F.col("reduced")), 4).alias("length"))


@query("v09_cluster_items", "vectors")
def _(v):
    return clustering.cluster_items(v, 4, 8, 4, 0.25, 1)[1]


@query("v12_match_one_to_one", "vectors")
def _(v):
    means = vectors.centroids(v, "label")
    other = vectors.centroids(v.where("vec_id % 2 = 0"), "label")
    return matching.match_one_to_one(other.select(F.col("label").cast("string").alias("cluster"), F.col("centroid").alias("vector")), means.select(F.col("label").cast("string").alias("name"), F.col("centroid").alias("vector")), 0.1).select("cluster", "name", F.round("sim", 5).alias("sim"))


@query("j14_match_boxes", "regions")
def _(regions):
    boxes = regions.selectExpr("region_id", "item_id", "user_verified", "det_score", "named_struct('x', CAST(region_id % 50 AS INT), 'y', CAST(region_id % 40 AS INT), 'w', w + 20, 'h', h + 20) AS box")
    return matching.match_boxes(boxes.where("user_verified = 1"), boxes.where("user_verified IS NULL")).select("item_id", "old_id", "new_id", F.round("iou", 6).alias("iou"))


# --- composed searches, naming, backfill


@query("v01_hybrid_search", "items", "item_tags", "labelled", "regions", "vectors", sql="""
SELECT h.item_id, h.path, h.mean_score, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS sim FROM (
  SELECT t.item_id, any_value(path) AS path, round(avg(score), 6) AS mean_score FROM item_tags t JOIN items i ON t.item_id = i.item_id WHERE tag = 'Brand#1' AND score >= 0.2 GROUP BY t.item_id) h
JOIN vectors v ON v.vec_id = h.item_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) q
WHERE h.item_id IN (SELECT r.item_id FROM labelled l JOIN regions r ON l.region_id = r.region_id WHERE run_id = 2 AND label_user = 'NATION_1')
ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, h.item_id LIMIT 50""")
def _(items, item_tags, labelled, regions, v):
    asked = v.where("vec_id = 7").first()["embedding"]
    found = search.hybrid_search(items, item_tags, labelled, regions, v.select(F.col("vec_id").alias("item_id"), "embedding"), asked, 50, ["Brand#1"], ["NATION_1"], 2, 0.2)
    return found.select("item_id", "path", r6("mean_score"), F.round("sim", 5).alias("sim"))


_NAMING = "naming AS (SELECT CAST(1000 + n_nationkey AS INT) AS cluster_id, CASE WHEN n_nationkey % 5 <> 0 THEN lower(n_name) END AS label FROM nation)"


def _naming(nation):
    return nation.selectExpr("CAST(1000 + n_nationkey AS INT) AS cluster_id", "CASE WHEN n_nationkey % 5 <> 0 THEN lower(n_name) END AS label")


@query("v15_name_clusters", "clusters", "nation", "vectors", sql=f"WITH {_NAMING} SELECT c.cluster_id, CASE WHEN n.cluster_id IS NOT NULL AND c.cluster_no <> -1 THEN n.label ELSE c.label_user END AS label_user FROM clusters c LEFT JOIN naming n ON c.cluster_id = n.cluster_id")
def _(clusters, nation, v):
    members = v.select((F.lit(1001) + F.col("vec_id") % 10).cast("int").alias("cluster_id"), "embedding")
    return feedback.name_clusters(clusters, _naming(nation), members, _identities(v))["clusters"].select("cluster_id", "label_user")


@query("v15_named_identities", "clusters", "nation", "vectors", sql=f"""
WITH {_NAMING}, m AS (SELECT n.label, v.embedding FROM vectors v JOIN clusters c ON c.cluster_id = 1001 + v.vec_id % 10 JOIN naming n ON n.cluster_id = c.cluster_id WHERE n.label IS NOT NULL AND c.cluster_no <> -1)
SELECT label AS name, count(*) AS n_samples, round(avg(embedding[1]::DOUBLE), 5) AS first FROM m GROUP BY label""")
def _(clusters, nation, v):
    members = v.select((F.lit(1001) + F.col("vec_id") % 10).cast("int").alias("cluster_id"), "embedding")
    found = feedback.name_clusters(clusters, _naming(nation), members, _identities(v).limit(0))["identities"]
    return found.select("name", "n_samples", F.round(F.col("centroid")[0], 5).alias("first"))


@query("v15_naming_rejected", "clusters", "nation", "vectors", sql=f"WITH {_NAMING} SELECT n.cluster_id, CASE WHEN c.cluster_id IS NULL THEN 'unknown cluster' ELSE 'noise' END AS reason FROM naming n LEFT JOIN clusters c ON n.cluster_id = c.cluster_id WHERE c.cluster_id IS NULL OR c.cluster_no = -1")
def _(clusters, nation, v):
    return feedback.name_clusters(clusters, _naming(nation), v.select(F.lit(0).alias("cluster_id"), "embedding").limit(0), _identities(v))["rejected"]


@query("v16_rename_identities", "vectors", sql=f"""
WITH {_CENTROIDS}, r AS (SELECT CASE WHEN label % 3 = 1 THEN CAST(label - 1 AS VARCHAR) WHEN label % 3 = 2 THEN concat('new ', CAST(label AS VARCHAR)) ELSE CAST(label AS VARCHAR) END AS name, centroid[1] AS x, n FROM cent WHERE label % 15 <> 6)
SELECT name, CAST(sum(n) AS BIGINT) AS n_samples, round(sum(x * n) / sum(n), 5) AS first FROM r GROUP BY name""")
def _(v):
    known = _identities(v)
    mapping = known.selectExpr("name AS old", "CASE WHEN CAST(name AS INT) % 3 = 1 THEN CAST(CAST(name AS INT) - 1 AS STRING) WHEN CAST(name AS INT) % 3 = 2 THEN concat('new ', name) WHEN CAST(name AS INT) % 15 = 6 THEN '' ELSE name END AS new")
    return feedback.rename_identities(known, mapping).select("name", "n_samples", F.round(F.col("centroid")[0], 5).alias("first"))


@query("v17_merge_identities", "vectors", sql=f"""
WITH {_CENTROIDS}, p AS (SELECT a.label AS s, a.centroid[1] AS sx, a.n AS sn, b.centroid[1] AS lx, b.n AS ln FROM cent a JOIN cent b ON b.label = a.label + 1 WHERE a.label % 2 = 0)
SELECT CAST(s AS VARCHAR) AS name, sn + ln AS n_samples, round((sx * least(sn, 200) + lx * ln) / (least(sn, 200) + ln), 5) AS first FROM p""")
def _(v):
    known = _identities(v)
    mapping = known.selectExpr("name AS survivor", "CAST(CAST(name AS INT) + 1 AS STRING) AS loser").where("CAST(survivor AS INT) % 2 = 0")
    return vectors.merge_identities(known, mapping)[0].select("name", "n_samples", F.round(F.col("centroid")[0], 5).alias("first"))


@query("v05_attach_log", "vectors", sql=f"""
WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT region_id, region_id * 10 AS item_id, 'named' AS action, name, dense_rank() OVER (ORDER BY name) AS cluster_id FROM top2 WHERE {_STATUS} = 'matched'""")
def _(v):
    regions = _regions_of(v).withColumn("item_id", F.col("region_id") * 10)
    found = vectors.auto_attach(regions, _identities(v), 0.1, 0.02, 0.3)
    return vectors.persist_attach(found, regions, _identities(v), 3)["log"].select("region_id", "item_id", "action", "name", F.col("cluster_id").cast("long").alias("cluster_id"))


@query("a16_blend_centroids", "vectors", sql=f"WITH {_CENTROIDS} SELECT label, round((centroid[1] * 200 + centroid[2] * n) / (200 + n), 5) AS first FROM cent")
def _(v):
    means = vectors.centroids(v, "label")
    shifted = F.concat(F.slice("centroid", 2, 1000), F.slice("centroid", 1, 1))
    return means.select("label", F.round(vectors.blend(F.col("centroid"), F.lit(5000), shifted, F.col("n"))[0], 5).alias("first"))


@query("f08_metadata_backfill", "items", sql="""
SELECT CASE WHEN item_id % 3 = 0 THEN 'skipped' WHEN item_id % 5 = 0 THEN 'missing' WHEN item_id % 7 = 0 THEN 'empty' ELSE 'filled' END AS status, count(*) AS n FROM items GROUP BY 1""")
def _(items):
    known = items.select("item_id", F.when(F.col("item_id") % 3 == 0, F.create_map(F.lit("make"), F.lit("x"))).alias("metadata"))
    raw = items.where("item_id % 5 <> 0").select("item_id", F.when(F.col("item_id") % 7 == 0, F.create_map(F.lit("Other"), F.lit("x"))).otherwise(F.create_map(F.lit("Make"), F.col("hash"))).alias("raw"))
    return files.metadata_backfill(known, raw)[1]


# --- scalar functions


@query("f01_degrees", "points", sql="SELECT item_id, round((floor(abs(lat)) + 30 / 60.0 + 15 / 3600.0) * CASE WHEN lat < 0 THEN -1 ELSE 1 END, 6) AS degrees FROM points")
def _(points):
    parts = F.array(F.floor(F.abs("lat")).cast("double"), F.lit(30.0), F.lit(15.0))
    return points.select("item_id", F.round(X.dms_to_degrees(parts, F.when(F.col("lat") < 0, " s").otherwise("N")), 6).alias("degrees"))


@query("f02_dates", "items", sql="SELECT item_id, CASE item_id % 3 WHEN 0 THEN strftime(mtime, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'garbage' END AS taken_at FROM items")
def _(items):
    text = F.when(F.col("item_id") % 3 == 0, F.date_format("mtime", "yyyy:MM:dd HH:mm:ss")).when(F.col("item_id") % 3 == 1, " garbage ").otherwise("  ")
    return items.select("item_id", X.parse_date(text).alias("taken_at"))


@query("f03_clean_text", "nation", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS name FROM nation")
def _(nation):
    nul = F.lit(chr(0))
    return nation.select("n_nationkey", X.clean_text(F.when(F.col("n_nationkey") % 4 == 0, F.concat(nul, F.lit("  "))).otherwise(F.concat(F.lit("  "), "n_name", nul, F.lit(" ")))).alias("name"))


@query("f04_rational", "items", sql="SELECT item_id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE round(item_id / CAST(item_id % 7 AS DOUBLE), 6) END AS value FROM items")
def _(items):
    return items.select("item_id", F.round(X.rational(F.concat_ws("/", F.col("item_id").cast("string"), (F.col("item_id") % 7).cast("string"))), 6).alias("value"))


@query("f05_first_text", "nation", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'other' END AS text FROM nation")
def _(nation):
    return nation.select("n_nationkey", X.first_text(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("  "), F.lit("other")).alias("text"))


@query("f06_metadata", "nation", sql="SELECT n_nationkey, n_name AS make, CAST(100 + n_nationkey AS INT) AS iso, 2.8::DOUBLE AS f_number, CAST(-(n_nationkey + 0.5) AS DOUBLE) AS lat FROM nation")
def _(nation):
    raw = F.create_map(*[c for k, v in (("Make", F.concat(F.col("n_name"), F.lit(" "))), ("ISOSpeedRatings", (100 + F.col("n_nationkey")).cast("string")), ("FNumber", F.lit("28/10")), ("GPSLatitude", F.concat(F.col("n_nationkey").cast("string"), F.lit(", 30, 0"))), ("GPSLatitudeRef", F.lit("S")), ("GPSLongitude", F.lit("1, 0, 0")), ("GPSLongitudeRef", F.lit("E"))) for c in (F.lit(k), v)])
    return nation.select("n_nationkey", X.normalize_metadata(raw).alias("m")).select("n_nationkey", "m.make", "m.iso", "m.f_number", F.col("m.gps.lat").alias("lat"))


@query("f07_json_field", "nation", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation")
def _(nation):
    text = F.when(F.col("n_nationkey") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("n_name").alias("a"))))
    return nation.select("n_nationkey", X.json_field(text, "$.a").alias("name"))


_BOXES = "b AS (SELECT region_id, region_id % 50 AS ax, region_id % 40 AS ay, w + 20 AS aw, h + 20 AS ah, region_id % 45 AS bx, region_id % 35 AS \"by\", w + 10 AS bw, h + 30 AS bh FROM regions), o AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, \"by\" + bh) - greatest(ay, \"by\"), 0) AS common FROM b)"


@query("f11_iou", "regions", sql=f"WITH {_BOXES} SELECT region_id, round(common / CAST(aw * ah + bw * bh - common AS DOUBLE), 6) AS iou FROM o")
def _(regions):
    box = lambda x, y, w, h: F.struct((F.col("region_id") % x).cast("int").alias("x"), (F.col("region_id") % y).cast("int").alias("y"), (F.col("w") + w).alias("w"), (F.col("h") + h).alias("h"))
    return regions.select("region_id", F.round(X.iou(box(50, 40, 20, 20), box(45, 35, 10, 30)), 6).alias("iou"))


@query("f12_exposure", "nation", sql="SELECT n_nationkey, printf('f/%.1f 1/%ds ISO %d %.0fmm', 2.8, 50 + n_nationkey, 100 + n_nationkey, 35.0) AS line FROM nation")
def _(nation):
    return nation.select("n_nationkey", X.exposure_summary(F.lit(2.8), 1 / (50 + F.col("n_nationkey")).cast("double"), 100 + F.col("n_nationkey"), F.lit(35.0)).alias("line"))


@query("s15_mapping_not_text", "nation", "clusters", sql="""
SELECT CAST(cluster_id AS VARCHAR) AS key, 'not a text' AS reason FROM clusters WHERE cluster_no <> -1 AND cluster_id % 2 = 0""")
def _(nation, clusters):
    entry = F.concat(F.lit('{"'), F.col("cluster_id").cast("string"), F.lit('": '), F.when(F.col("cluster_id") % 2 == 0, "17").otherwise('"x"'), F.lit("}"))
    return feedback.rename_bulk(clusters, feedback.read_mapping(clusters.where("cluster_no <> -1").select(entry.alias("j")), "j"))[1]


# --- purge, sidecars, constraints


@query("s11_purge", "regions", "assignments", "identities", "corrections", sql="""
SELECT 'regions' AS name, 0::BIGINT AS n UNION ALL SELECT 'assignments', 0 UNION ALL SELECT 'identities', count(*) FROM identities UNION ALL SELECT 'corrections', count(*) FROM corrections""")
def _(regions, assignments, identities, corrections):
    left = tables.purge({"regions": regions, "assignments": assignments, "identities": identities, "corrections": corrections})
    return tables.union_all([t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in left.items()])


@query("s18_sidecar_diff", "items", sql="SELECT CASE WHEN item_id % 2 = 0 AND item_id % 3 = 0 THEN 'skipped' ELSE 'written' END AS status, count(*) AS n FROM items GROUP BY 1")
def _(items):
    plan = items.select("path", "mtime", F.array("hash", F.lit("x")).alias("subjects"))
    existing = items.where("item_id % 2 = 0").select("path", F.col("mtime").alias("sidecar_mtime"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("x"), F.col("hash"))).otherwise(F.array(F.lit("y"))).alias("existing_subjects"))
    return export.sidecar_diff(plan, existing).groupBy("status").agg(F.count("*").alias("n"))


@query("s19_sidecar_packets", "nation", sql="""
SELECT concat(n_name, '.xmp') AS sidecar_path, concat('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/"><dc:subject><rdf:Bag><rdf:li>',
  n_name, '</rdf:li><rdf:li>a &amp; &lt;b&gt;</rdf:li></rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:Bag><rdf:li>c|', n_name, '</rdf:li></rdf:Bag></lr:hierarchicalSubject></rdf:Description></rdf:RDF></x:xmpmeta>') AS body FROM nation""")
def _(nation):
    plan = nation.select(F.col("n_name").alias("path"), F.array("n_name", F.lit("a & <b>")).alias("subjects"), F.array(F.concat(F.lit("c|"), "n_name")).alias("hierarchical"))
    return export.sidecar_packets(plan)


@query("v13_apply_constraints", "corrections", "clusters", sql=f"""
WITH {_INTENT}, gone AS (SELECT DISTINCT l.region_id, c.label_user AS label FROM corrections l JOIN clusters c ON l.cluster_id = c.cluster_id WHERE action = 'unassigned' AND label_user IS NOT NULL),
cannot AS (SELECT DISTINCT least(g.region_id, i.region_id) AS src, greatest(g.region_id, i.region_id) AS dst FROM gone g JOIN intent i ON i.name = g.label AND i.action = 'named' WHERE g.region_id <> i.region_id),
must AS (SELECT min(region_id) OVER (PARTITION BY name) AS src, region_id AS dst FROM intent WHERE action = 'named'),
edges AS (SELECT DISTINCT region_id AS src, region_id + 1 AS dst, 0.5::DOUBLE AS weight FROM corrections UNION ALL SELECT src, dst, 0.0::DOUBLE FROM must WHERE src <> dst)
SELECT e.src, e.dst, min(weight) AS weight FROM edges e LEFT JOIN cannot c ON e.src = c.src AND e.dst = c.dst WHERE c.src IS NULL GROUP BY e.src, e.dst""")
def _(corrections, clusters):
    edges = corrections.select(F.col("region_id").alias("src"), (F.col("region_id") + 1).alias("dst"), F.lit(0.5).alias("weight")).distinct()
    return feedback.apply_constraints(edges, feedback.must_links(corrections), feedback.rejections(corrections, clusters))


@query("v21_pick_region", "regions", sql="""
WITH r AS (SELECT region_id, item_id, region_id % 50 AS x, region_id % 40 AS y, w + 20 AS w, h + 20 AS h, det_score FROM regions),
q AS (SELECT item_id AS request_id, item_id, min(x) AS x, min(y) AS y FROM r GROUP BY item_id)
SELECT request_id, region_id FROM (SELECT q.request_id, r.region_id, row_number() OVER (PARTITION BY q.request_id ORDER BY det_score DESC, r.region_id) AS k FROM q JOIN r ON q.item_id = r.item_id
  WHERE r.x + r.w / 2 BETWEEN q.x AND q.x + 60 AND r.y + r.h / 2 BETWEEN q.y AND q.y + 60) t WHERE k = 1""")
def _(regions):
    boxes = regions.selectExpr("region_id", "item_id", "det_score", "named_struct('x', CAST(region_id % 50 AS INT), 'y', CAST(region_id % 40 AS INT), 'w', w + 20, 'h', h + 20) AS box")
    drawn = boxes.groupBy("item_id").agg(F.struct(F.min("box.x").alias("x"), F.min("box.y").alias("y"), F.lit(60).alias("w"), F.lit(60).alias("h")).alias("box")).select(F.col("item_id").alias("request_id"), "item_id", "box")
    return people.pick_region(drawn, boxes).select("request_id", "region_id")


# --- joins of base tables, one-to-one matching and clustering where the answer is plain


@query("j01_tagged_items", "lineitem", "part", "orders", sql="""
SELECT l_orderkey AS item_id, l_quantity / 50.0 AS score, p_brand AS tag, concat('size', p_size % 3) AS kind, concat(o_orderpriority, '/', o_orderkey) AS path
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""")
def _(lineitem, part, orders):
    facts = lineitem.selectExpr("l_orderkey AS item_id", "l_partkey AS tag_id", "l_quantity / 50.0D AS score")
    tags = part.selectExpr("p_partkey AS tag_id", "p_brand AS tag", "concat('size', p_size % 3) AS kind")
    return search.tagged_items(facts, tags, orders.selectExpr("o_orderkey AS item_id", "concat(o_orderpriority, '/', o_orderkey) AS path"))


@query("j01_split_tags", "item_tags", sql="""
SELECT item_id, tag, score, model_name, CASE WHEN model_name = 'geo_v1' THEN 'geo' ELSE 'label' END AS kind FROM item_tags""")
def _(item_tags):
    tags, facts = search.split_tags(item_tags)
    return search.tagged_items(facts, tags)


@query("j04_labelled_assignments", "assignments", "clusters", sql="""
SELECT a.region_id, a.run_id, a.cluster_no, round(a.distance, 6) AS distance, c.cluster_id, c.label_user FROM assignments a JOIN clusters c ON a.run_id = c.run_id AND a.cluster_no = c.cluster_no""")
def _(assignments, clusters):
    return people.labelled_assignments(assignments, clusters).withColumn("distance", F.round("distance", 6))


_OLD = "SELECT event_id AS region_id, event_id AS item_id, CASE WHEN event_id % 4 = 0 THEN 1 END AS user_verified FROM events WHERE event_id % 2 = 0"


def _boxes(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An item for every second region with one old box, and every third with one new box: in the same place, or far off where the id ends in 6."""
    box = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(20).alias("w"), F.lit(20).alias("h"))
    own = regions.select("region_id", F.col("region_id").alias("item_id"))
    old = own.where("region_id % 2 = 0").withColumns({"user_verified": F.when(F.col("region_id") % 4 == 0, 1), "box": box(0)})
    new = own.where("region_id % 3 = 0").withColumns({"region_id": F.col("region_id") + 10_000_000, "user_verified": F.lit(None).cast("int"), "box": F.when(F.col("region_id") % 10 == 6, box(100)).otherwise(box(1))})
    return old, new


@query("j14_match_single_boxes", "regions", sql="""
SELECT event_id AS item_id, event_id AS old_id, event_id + 10000000 AS new_id, round(380.0 / 420.0, 6) AS iou FROM events WHERE event_id % 6 = 0 AND event_id % 10 <> 6""")
def _(regions):
    return matching.match_boxes(*_boxes(regions)).withColumn("iou", F.round("iou", 6))


@query("j15_redetect_merge", "regions", sql=f"""
WITH old AS ({_OLD}), fresh AS (SELECT event_id AS item_id FROM events WHERE event_id % 3 = 0)
SELECT region_id, user_verified FROM old WHERE user_verified = 1 AND item_id IN (SELECT item_id FROM fresh WHERE item_id % 10 <> 6)
UNION ALL SELECT item_id + 10000000, NULL FROM fresh WHERE NOT (item_id % 4 = 0 AND item_id % 10 <> 6)""")
def _(regions):
    return matching.redetect_merge(*_boxes(regions)).select("region_id", "user_verified")


@query("s02_fingerprint", "documents", sql="SELECT min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text")
def _(documents):
    return files.fingerprint(documents, "text").groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).drop("hash")


@query("f10_euclidean", "vectors", sql="""
SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS apart FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""")
def _(v):
    follower = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(follower, "vec_id").select("vec_id", F.round(X.euclidean(F.col("embedding"), F.col("other")), 5).alias("apart"))


@query("v06_attach_one", "vectors", sql=f"""
WITH {_CENTROIDS}, {_SIMS}, {_TOP2} SELECT region_id, round(1 - sim, 5) AS distance, 'cosine_dist' AS distance_kind FROM top2 WHERE {_STATUS} = 'matched' ORDER BY region_id LIMIT 1""")
def _(v):
    found = vectors.auto_attach(_regions_of(v), _identities(v), 0.1, 0.02, 0.3)
    one = found.where("status = 'matched'").orderBy("region_id").limit(1)
    return vectors.persist_attach(one, _regions_of(v), _identities(v), 3)["assignments"].select("region_id", F.round("distance", 5).alias("distance"), "distance_kind")


@query("v12_match_same_means", "vectors", sql=f"WITH {_CENTROIDS} SELECT CAST(label AS VARCHAR) AS cluster, CAST(label AS VARCHAR) AS name, CAST(1.0 AS DOUBLE) AS sim FROM cent")
def _(v):
    means = vectors.centroids(v, "label").select(F.col("label").cast("string").alias("cluster"), F.col("centroid").alias("vector"))
    return matching.match_one_to_one(means, means.withColumnRenamed("cluster", "name"), 0.1).withColumn("sim", F.round("sim", 5))


#: Clusters of customers that stand on a circle by nation, far from other nations and next to nothing apart within their own.
_NATIONS = """sizes AS (SELECT c_nationkey AS nation, count(*) AS n, min(c_custkey) AS least FROM customer {where} GROUP BY c_nationkey),
numbered AS (SELECT nation, row_number() OVER (ORDER BY least) - 1 AS cluster_no FROM sizes WHERE n >= 3)"""


def _circle(customer: DataFrame) -> DataFrame:
    angle = F.col("c_nationkey") * (2 * math.pi / 25)
    return customer.select(F.col("c_custkey").alias("vec_id"), F.array(F.cos(angle), F.sin(angle), F.col("c_custkey") % 2 * 1e-3).alias("embedding"))


_PLAIN = {"n_components": 2, "min_size": 3, "min_samples": 2, "eps": 0.05}


@query("v08_density_hierarchy", "customer", sql=f"""
WITH {_NATIONS.format(where="")} SELECT c_custkey AS vec_id, coalesce(cluster_no, -1) AS cluster_no FROM customer LEFT JOIN numbered ON nation = c_nationkey""")
def _(customer):
    places = _circle(customer).withColumnRenamed("embedding", "reduced")
    return clustering.density_hierarchy(places, 3, 2, 0.1, 4).select("vec_id", "cluster_no")


@query("v08_density_of_prices", "orders", sql="""
WITH near AS (SELECT o_orderkey AS vec_id, o_totalprice AS x, count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 200.005 PRECEDING AND 200.005 FOLLOWING) - 1 AS n FROM orders),
core AS (SELECT vec_id, x, CASE WHEN x - lag(x) OVER (ORDER BY x, vec_id) <= 200.005 THEN 0 ELSE 1 END AS opens FROM near WHERE n >= 5),
parts AS (SELECT vec_id, sum(opens) OVER (ORDER BY x, vec_id ROWS UNBOUNDED PRECEDING) AS part FROM core),
numbered AS (SELECT part, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cluster_no FROM parts GROUP BY part HAVING count(*) >= 6)
SELECT o_orderkey AS vec_id, coalesce(cluster_no, -1) AS cluster_no FROM orders LEFT JOIN parts ON vec_id = o_orderkey LEFT JOIN numbered USING (part)""")
def _(orders):
    return clustering.density_cluster(orders.select(F.col("o_orderkey").alias("vec_id"), F.array("o_totalprice").alias("reduced")), 6, 5, 200.005)


@query("v09_cluster_plain_items", "customer", sql=f"""
WITH {_NATIONS.format(where="")} SELECT c_custkey AS vec_id, 5 AS run_id, coalesce(cluster_no, -1) AS cluster_no, CAST(0.0 AS DOUBLE) AS distance FROM customer LEFT JOIN numbered ON nation = c_nationkey""")
def _(customer):
    return clustering.cluster_items(_circle(customer), run_id=5, **_PLAIN)[1].withColumn("distance", F.round("distance", 2))


@query("v10_cluster_regions", "customer", "nation", sql=f"""
WITH {_NATIONS.format(where="")}, named AS (SELECT c_nationkey AS nation FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer))
SELECT c_custkey AS region_id, CASE WHEN cluster_no IS NULL THEN NULL WHEN c_nationkey IN (SELECT nation FROM named) THEN 'asserted' ELSE n_name END AS label_user
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN numbered ON numbered.nation = c_nationkey""")
def _(customer, nation):
    means = vectors.centroids(_circle(customer).join(customer.select(F.col("c_custkey").alias("vec_id"), "c_nationkey"), "vec_id"), "c_nationkey")
    known = nation.join(means, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("name"), "centroid")
    log = customer.agg(F.min("c_custkey").alias("region_id")).select(F.lit(1).cast("long").alias("id"), "region_id", F.lit("named").alias("action"), F.lit(None).cast("long").alias("cluster_id"), F.lit("asserted").alias("name"))
    labelled, moved = clustering.cluster_regions(_circle(customer), known, log, 0.99, run_id=7, **_PLAIN)
    return moved.join(labelled.select("cluster_no", "label_user"), "cluster_no").select("region_id", "label_user")


@query("v11_recluster_orphans", "customer", sql=f"""
WITH {_NATIONS.format(where="WHERE c_nationkey < 12")} SELECT c_custkey AS vec_id, coalesce(cluster_no, -1) AS cluster_no FROM customer LEFT JOIN numbered ON nation = c_nationkey WHERE c_nationkey < 12""")
def _(customer):
    orphans = customer.where("c_nationkey < 12").select(F.col("c_custkey").alias("region_id"))
    return clustering.recluster_orphans(_circle(customer), orphans, run_id=8, **_PLAIN)[1].select("vec_id", "cluster_no")


@query("v11b_refine_noise", "customer", "nation", sql=f"""
WITH {_NATIONS.format(where="WHERE c_nationkey >= 12")} SELECT cluster_no, n_name AS label_auto FROM numbered JOIN nation ON n_nationkey = nation""")
def _(customer, nation):
    members = customer.select(F.col("c_custkey").alias("vec_id"), F.when(F.col("c_nationkey") >= 12, -1).otherwise(0).alias("cluster_no"))
    tags = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("item_id"), F.col("n_name").alias("tag"))
    return clustering.refine_noise(_circle(customer), members, tags, run_id=9, **_PLAIN)[2]


# --- scoring by the fake models; every tenth content cannot be read

_CONTENTS = "contents AS (SELECT p_partkey AS item_id, concat(CASE WHEN p_partkey % 10 = 0 THEN 'bad ' ELSE '' END, p_brand, p_partkey) AS content FROM part), hashed AS (SELECT *, sha256(content) AS h FROM contents)"


def _contents(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("item_id"), F.concat(F.when(F.col("p_partkey") % 10 == 0, "bad ").otherwise(""), "p_brand", F.col("p_partkey").cast("string")).alias("content"))


def _byte(n: str) -> str:
    return f"CAST(concat('0x', substr(h, 2 * ({n}) + 1, 2)) AS INT)"


@query("x01_score_tags", "part", sql=f"""
WITH {_CONTENTS}, each AS (SELECT item_id, {_byte("i")} AS b FROM hashed, range(3) t(i) WHERE content NOT LIKE 'bad%')
SELECT item_id, ['cat', 'dog', 'tree', 'beach', 'car', 'smile', 'night'][b % 7 + 1] AS tag, 0.5 + b / 512.0 AS score, 'fake' AS model_name, NULL AS error FROM each WHERE 0.5 + b / 512.0 >= 0.7
UNION ALL SELECT item_id, NULL, NULL, 'fake', 'ValueError: unreadable' FROM contents WHERE content LIKE 'bad%'""")
def _(part):
    return scoring.score_tags(_contents(part), scoring.FakeTagger, "fake", 0.7)


@query("x02_embed", "part", sql=f"""
WITH {_CONTENTS}, each AS (SELECT item_id, i, {_byte("i")} - 127.5 AS x FROM hashed, range(8) t(i))
SELECT item_id, round(max(CASE WHEN i = 0 THEN x END) / sqrt(sum(x * x)), 4) AS first, round(max(CASE WHEN i = 7 THEN x END) / sqrt(sum(x * x)), 4) AS last FROM each GROUP BY item_id""")
def _(part):
    found = scoring.embed(_contents(part), scoring.FakeEmbedder, "fake")
    return found.select("item_id", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), F.round(F.col("vector")[7].cast("double"), 4).alias("last"))


_DETECTED = f"""
WITH {_CONTENTS} SELECT item_id, {_byte("i")} AS x, {_byte("i + 1")} AS y, 20 + i AS w, 30 + i AS h, {_byte("i + 2")} / 256.0 AS det_score, NULL AS error FROM hashed, range(1, 4) t(i) WHERE i <= {_byte("0")} % 4 AND content NOT LIKE 'bad%'
UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, NULL, 'ValueError: unreadable' FROM contents WHERE content LIKE 'bad%'"""


@query("x03_detect", "part", sql=_DETECTED)
def _(part):
    return scoring.detect(_contents(part), scoring.FakeDetector, "fake").drop("vector", "model_name")


@query("x03_detect_lateral", "part", sql=_DETECTED)
def _(part):
    return scoring.detect_lateral(_contents(part), scoring.FakeDetector).drop("vector")
