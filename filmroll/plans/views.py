"""Catalog tables derived from the given ones, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: In an order in which each uses only those before it.
VIEWS = {
    "items": "SELECT o_orderkey AS item_id, concat(o_orderpriority, '/', CAST(o_orderkey AS STRING), '.img') AS path, md5(CAST(o_custkey AS STRING)) AS hash, o_orderdate AS mtime FROM orders",
    "item_tags": "SELECT l_orderkey AS item_id, p_brand AS tag, l_quantity / 50.0 AS score, CASE WHEN p_size % 10 = 0 THEN 'geo_v1' ELSE concat('tagger_', l_returnflag) END AS model_name FROM lineitem JOIN part ON l_partkey = p_partkey",
    "regions": "SELECT event_id AS region_id, user_id AS item_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS w, CAST(event_id % 60 AS INT) AS h, least(value / 50.0, 1.0) AS det_score, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END AS user_verified FROM events",
    "assignments": "SELECT event_id AS region_id, 1 AS run_id, CAST(user_id % 10 AS INT) AS cluster_no, value / 500.0 AS distance FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 2, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 - 1, value / 400.0 FROM events WHERE event_id % 2 = 0",
    "clusters": "SELECT run_id * 1000 + cluster_no + 1 AS cluster_id, run_id, cluster_no, CASE WHEN cluster_no >= 0 AND cluster_no % 3 <> 0 THEN max(n_name) END AS label_user, count(*) + CASE WHEN cluster_no = 3 THEN 7 ELSE 0 END AS size FROM assignments LEFT JOIN nation ON n_nationkey = cluster_no GROUP BY run_id, cluster_no",
    "corrections": "SELECT event_id AS id, user_id AS region_id, CASE event_type WHEN 'error' THEN 'unassigned' WHEN 'click' THEN 'named' WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'unverified' ELSE 'deleted' END AS action, 1001 + user_id % 10 AS cluster_id, CASE WHEN event_type = 'click' THEN n_name END AS name, ts AS created_at FROM events JOIN nation ON n_nationkey = event_id % 25",
    "vectors": "SELECT vec_id, embedding, label FROM embeddings",
    "tag_category": "SELECT DISTINCT p_brand AS tag, r_name AS category FROM part JOIN region ON r_regionkey = CAST(substring(p_brand, 7) AS INT) % 5 WHERE CAST(substring(p_brand, 7) AS INT) % 2 = 0",
    "item_category": "SELECT o_orderkey AS item_id, r_name AS category FROM orders JOIN region ON r_regionkey = o_custkey % 5 WHERE o_orderkey % 97 = 0",
    "places": "SELECT n_nationkey AS place_id, n_name AS city, substring(n_name, 1, 2) AS country, CAST(((n_nationkey * 3571) % 16000) / 100.0 - 80 AS DOUBLE) AS lat, CAST(((n_nationkey * 7907) % 36000) / 100.0 - 180 AS DOUBLE) AS lon FROM nation",
    "points": "SELECT c_custkey AS item_id, CAST(((c_custkey * 7919) % 18000) / 100.0 - 90 AS DOUBLE) AS lat, CAST(((c_custkey * 104729) % 36000) / 100.0 - 180 AS DOUBLE) AS lon FROM customer",
    "labelled": "SELECT a.region_id, a.run_id, a.cluster_no, a.distance, c.cluster_id, c.label_user FROM assignments a JOIN clusters c ON a.run_id = c.run_id AND a.cluster_no = c.cluster_no",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY run_id DESC, cluster_id DESC) AS rn FROM labelled) t WHERE rn = 1",
    "members": "SELECT o_orderkey AS item_id, 1 AS run_id, CAST(o_custkey % 20 - 1 AS INT) AS cluster_no, o_custkey % 20 AS cluster_id, o_totalprice / 500000.0 AS distance FROM orders",
    "cluster_category": "SELECT n_nationkey AS cluster_id, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey BETWEEN 1 AND 5",
    "identities": "SELECT n_name AS name FROM nation",
}


def _uses(sql: str, names: object) -> set[str]:
    return {n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}


def ctes(sql: str) -> str:
    """``sql`` with the definitions of all views that it uses in front."""
    need, todo = set(), _uses(sql, VIEWS)
    while todo:
        need |= todo
        todo = set().union(*(_uses(VIEWS[n], VIEWS) for n in todo)) - need
    inner = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in need)
    if not inner:
        return sql
    return f"WITH {inner},\n{sql.lstrip()[5:]}" if sql.lstrip()[:5].upper() == "WITH " else f"WITH {inner}\n{sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One catalog table over the Parquet tables in ``sf_dir``."""
    sql = ctes(f"SELECT * FROM {name}")
    for table in _uses(sql, BASE):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)
