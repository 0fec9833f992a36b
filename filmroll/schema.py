"""Tables of a media catalog: an item is a file, a region a box inside an item, an identity a named person or thing."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType(), False)
BOX = T.StructType([T.StructField(n, _I) for n in ("x", "y", "w", "h")])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "items": _table(item_id=_L, path=_S, hash=_S, mtime=_D, width=_I, height=_I, metadata=T.MapType(_S, _S), processed_at=_TS),
    "item_tags": _table(item_id=_L, tag=_S, model_name=_S, score=_D),
    "embeddings": _table(item_id=_L, model_name=_S, dim=_I, vector=VECTOR),
    "cluster_runs": _table(run_id=_L, created_at=_TS, params=_S),
    "clusters": _table(cluster_id=_L, run_id=_L, cluster_no=_I, label_auto=_S, label_user=_S, size=_L),
    "item_clusters": _table(item_id=_L, cluster_id=_L, distance=_D),
    "regions": _table(region_id=_L, item_id=_L, box=BOX, det_score=_D, vector=VECTOR, model_name=_S, verified=_I, user_verified=_I),
    "assignments": _table(region_id=_L, cluster_id=_L, distance=_D, distance_kind=_S),
    "identities": _table(name=_S, centroid=T.ArrayType(_D, False), dim=_I, n_samples=_L, sim_n=_L, sim_mean=_D, sim_m2=_D),
    "corrections": _table(id=_L, region_id=_L, item_id=_L, action=_S, cluster_id=_L, name=_S, created_at=_TS),
    "tag_category": _table(tag=_S, category=_S),
    "cluster_category": _table(cluster_id=_L, category=_S),
    "item_category": _table(item_id=_L, category=_S),
}

#: Columns by which each table's rows are told apart.
KEYS = {
    "items": ["path"],
    "item_tags": ["item_id", "tag", "model_name"],
    "embeddings": ["item_id", "model_name"],
    "clusters": ["cluster_id"],
    "item_clusters": ["item_id", "cluster_id"],
    "regions": ["region_id"],
    "assignments": ["region_id", "cluster_id"],
    "identities": ["name"],
    "corrections": ["id"],
    "tag_category": ["tag"],
    "cluster_category": ["cluster_id"],
    "item_category": ["item_id"],
}

#: parent table -> (child table, shared column); deleting a parent row deletes its children. The log has no parent.
CHILDREN = {
    "items": [("item_tags", "item_id"), ("embeddings", "item_id"), ("item_clusters", "item_id"), ("regions", "item_id"), ("item_category", "item_id")],
    "regions": [("assignments", "region_id")],
    "cluster_runs": [("clusters", "run_id")],
    "clusters": [("item_clusters", "cluster_id"), ("assignments", "cluster_id"), ("cluster_category", "cluster_id")],
}
