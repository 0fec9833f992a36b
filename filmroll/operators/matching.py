"""One-to-one matching, of clusters to identities and of boxes to boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import cosine, iou
from filmroll.operators.graph import components
from filmroll.sources.staging import small, staged


#: Entries of the matrix of a component that one task solves exactly (64 MB); larger ones go to the auction.
CELLS = 8_000_000


def assign(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each row (-1: none) in a matching of largest total gain, and row and column prices that prove it.

    Shortest augmenting paths (Kuhn; Jonker and Volgenant): no gain is above the
    sum of its row's and column's prices, none of which is negative, and the prices sum up to the total.
    """
    n, m = gain.shape
    cost = np.hstack([-gain, np.zeros((n, n))])  # the columns behind stand for staying alone
    u, v = np.zeros(n + 1), np.zeros(n + m + 1)
    row_of, back = np.zeros(n + m + 1, dtype=np.int64), np.zeros(n + m, dtype=np.int64)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(n + m, np.inf), np.zeros(n + m + 1, dtype=bool)
        while True:
            used[j] = True
            free = ~used[1:]
            slack = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            closer = free & (slack < least)
            least[closer], back[closer] = slack[closer], j
            then = int(np.argmin(np.where(free, least, np.inf))) + 1
            step = least[then - 1]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j = then
            if not row_of[j]:
                break
        while j:
            row_of[j], j = row_of[back[j - 1]], back[j - 1]
    found = np.full(n, -1, dtype=np.int64)
    held = np.flatnonzero(row_of[1 : m + 1])
    found[row_of[1 : m + 1][held] - 1] = held
    return found, -u[1:], -v[1 : m + 1]


def _solve(table: pa.Table) -> pa.Table:
    """The matching of one component's pairs (cluster, name, sim)."""
    clusters, rows = np.unique(table["cluster"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    names, columns = np.unique(table["name"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    sims, gain = table["sim"].to_numpy(), np.zeros((len(clusters), len(names)))
    gain[rows, columns] = sims + 1  # to stay alone is worth a similarity of -1
    found = assign(gain)[0]
    return table.select(["cluster", "name", "sim"]).filter(pa.array(found[rows] == columns))


def match_one_to_one(clusters: DataFrame, identities: DataFrame, threshold: float, epsilon: float = 1e-4, most: int = 20_000, rounds: int = 10_000) -> DataFrame:
    """V12. cluster, name and sim of a one-to-one matching of largest total similarity over pairs from ``threshold``, staying alone being worth -1.

    Pairs from the threshold on fall into components, which are matched apart:
    those up to CELLS exactly, each in a task, larger ones by a distributed
    auction (:func:`auction`), whose total is within ``epsilon`` of the best for every
    cluster. ``clusters``: cluster, vector; ``identities``: name, vector.
    """
    if not small(identities, most):
        raise ValueError(f"more than {most} identities")
    pool = F.broadcast(identities.select("name", F.col("vector").alias("_v"), F.size("vector").alias("_dim")))
    pairs = clusters.select("cluster", "vector", F.size("vector").alias("_dim")).join(pool, "_dim").select("cluster", "name", cosine(F.col("vector"), F.col("_v")).alias("sim")).where(F.col("sim") >= threshold)
    pairs = staged(pairs)
    sizes = [F.count_distinct("cluster").alias("n"), F.count_distinct("name").alias("m")]
    cells = F.col("n") * (F.col("n") + F.col("m"))
    if pairs.agg(*sizes).select(cells).first()[0] <= CELLS:
        return pairs.groupBy(F.lit(0).alias("root")).applyInArrow(_solve, "cluster string, name string, sim double")
    rooted = pairs.withColumns({"u": F.concat(F.lit("c:"), "cluster"), "v": F.concat(F.lit("n:"), "name")})
    roots = components(rooted.select("u", "v"))
    rooted = staged(rooted.join(roots.select(F.col("node").alias("u"), "root").hint("merge"), "u", "left").select(F.coalesce("root", "u").alias("root"), "cluster", "name", "sim"))
    large = rooted.groupBy("root").agg(*sizes).where(cells > CELLS).select("root")
    exact = rooted.join(large.hint("merge"), "root", "left_anti").groupBy("root").applyInArrow(_solve, "cluster string, name string, sim double")
    return exact.unionByName(auction(staged(rooted.join(large.hint("merge"), "root", "left_semi").drop("root")), epsilon, rounds))


def auction(pairs: DataFrame, epsilon: float = 1e-4, rounds: int = 10_000) -> DataFrame:
    """V12. A matching of near-largest total of stored pairs (cluster, name, sim), by a distributed auction (Bertsekas).

    Clusters without an identity bid for the one that gives them most after its
    price; an identity goes to the highest bidder, whose bid becomes its price.
    Bids beat the second choice by ``epsilon``. A cluster stays alone once every
    identity costs more than a similarity of -1 is worth.
    """
    spark = pairs.sparkSession
    owned = spark.createDataFrame([], "name string, cluster string, price double")
    out = spark.createDataFrame([], "cluster string")
    for _ in range(rounds):
        free = pairs.join(owned.select("cluster"), "cluster", "left_anti").join(out, "cluster", "left_anti")
        gains = free.join(owned.select("name", "price"), "name", "left").withColumn("gain", F.col("sim") - F.coalesce("price", F.lit(0.0)))
        order = W.partitionBy("cluster").orderBy(F.desc("gain"), "name")
        best = gains.withColumn("_n", F.row_number().over(order)).withColumn("_second", F.lead("gain").over(order)).where("_n = 1")
        alone = best.where(F.col("gain") < -1.0).select("cluster")  # prices beyond any gain
        bids = best.where(F.col("gain") >= -1.0).select("name", "cluster", (F.coalesce("price", F.lit(0.0)) + F.col("gain") - F.greatest(F.coalesce("_second", F.lit(-1.0)), F.lit(-1.0)) + epsilon).alias("price"))
        won = staged(bids.groupBy("name").agg(F.max_by(F.struct("cluster", "price"), F.struct("price", "cluster")).alias("w")).select("name", "w.cluster", "w.price"))
        gone = staged(alone)
        if won.isEmpty() and gone.isEmpty():
            break
        owned = staged(owned.join(won.select("name"), "name", "left_anti").unionByName(won))
        out = staged(out.unionByName(gone))
    else:
        raise RuntimeError(f"the auction did not end in {rounds} rounds: raise rounds or epsilon")
    return pairs.join(owned.select("name", "cluster"), ["name", "cluster"]).select("cluster", "name", "sim")


def match_boxes(old: DataFrame, new: DataFrame, min_iou: float = 0.4) -> DataFrame:
    """J14. old_id and new_id of boxes that overlap, the largest old box choosing first, every new box used once.

    Candidates come from an equi-join on the item; an item's overlapping pairs
    stand in the order of choice and are gone through once, so each item's
    result follows its pairs.
    """
    joined = old.select("item_id", F.col("region_id").alias("old_id"), F.col("box").alias("_a")).join(new.select("item_id", F.col("region_id").alias("new_id"), F.col("box").alias("_b")), "item_id")
    scored = joined.withColumn("iou", iou(F.col("_a"), F.col("_b"))).where(F.col("iou") >= min_iou)
    rank = F.struct((-F.col("_a.w") * F.col("_a.h")).alias("size"), "old_id", (-F.col("iou")).alias("worse"), "new_id")
    pairs = scored.groupBy("item_id").agg(F.array_sort(F.collect_list(rank)).alias("p"))
    kind = "array<struct<size:{},old_id:bigint,worse:double,new_id:bigint>>".format(scored.select((-F.col("_a.w") * F.col("_a.h")).alias("s")).schema["s"].dataType.simpleString())
    taken = F.aggregate("p", F.array().cast(kind), lambda t, x: F.when(F.exists(t, lambda y: (y["old_id"] == x["old_id"]) | (y["new_id"] == x["new_id"])), t).otherwise(F.concat(t, F.array(x))))
    return pairs.select("item_id", F.explode(taken).alias("t")).select("item_id", "t.old_id", "t.new_id", (-F.col("t.worse")).alias("iou"))


def redetect_merge(old: DataFrame, new: DataFrame, min_iou: float = 0.4) -> DataFrame:
    """J15. Regions after a new detection: matched confirmed ones stay, all other old ones go, unmatched new ones come."""
    checked = old.where(F.coalesce("user_verified", F.lit(0)) == 1)
    pairs = staged(match_boxes(checked, new, min_iou))
    kept = checked.join(pairs.select(F.col("old_id").alias("region_id")), "region_id", "left_semi")
    added = new.join(pairs.select(F.col("new_id").alias("region_id")), "region_id", "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)
