"""Vector analytics: centroids, running statistics, and similarity joins against identities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.functions.scalars import validate_threshold
from filmroll.sources.staging import small, staged

#: Identities that are sent to every executor as one matrix; more are joined block by block.
MATRIX_ROWS = 20_000
BLOCK_ROWS = 4_096
#: Vectors that meet a block of identities at once.
PACK_ROWS = 8_192


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """A15. Mean vector and size of every group; partial sums are made where the rows are."""
    sums = vectors.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    rows = sums.groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return rows.select(group, "n", F.transform("c", lambda e: e["x"]).alias("centroid"))


def blend(old: Column, n_old: Column, new: Column, n_new: Column, cap: int | None = 200) -> Column:
    """A16. Weighted mean of two centroids, the old one's weight capped."""
    weight = F.least(n_old, F.lit(cap)) if cap is not None else n_old
    return F.zip_with(old, new, lambda a, b: (a * weight + b * n_new) / (weight + n_new))


def running_stats(sims: DataFrame, group: str, value: str) -> DataFrame:
    """A17. n, mean and sum of squared deviations of every group."""
    return sims.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merge_stats(a: Column, b: Column) -> Column:
    """A17. Two (n, mean, m2) triples in one; either may be null."""
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    merged = F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a.isNull() | (F.coalesce(a["n"], F.lit(0)) == 0), b).when(b.isNull() | (F.coalesce(b["n"], F.lit(0)) == 0), a).otherwise(merged)


TOP2 = "region_id long, name string, sim double, second double, n_excluded int"


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, dtype=np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def top2(vectors: DataFrame, identities: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """J11, V3. For every vector (region_id, embedding) its best identity (name, centroid) and the runner-up's similarity.

    Identities of another dimension, and those that ``excluded`` (region_id,
    label) names for the region, take no part. Blocks of vectors meet the
    identities as one matrix product and leave one row each. Few identities are
    sent to the executors; more are dealt into blocks that meet packs of
    vectors, and the blocks' winners are merged.
    """
    few = few_rows(identities.select("name", "centroid"))
    return _top2_few(vectors, few, excluded) if few is not None else _top2_many(vectors, identities, excluded)


def few_rows(identities: DataFrame) -> list | None:
    """The rows, by name, of a table of up to MATRIX_ROWS; None if there are more. Computes it once."""
    rows = identities.limit(MATRIX_ROWS + 1).collect()
    return sorted(rows, key=lambda r: (r["name"] is None, r["name"] or "")) if len(rows) <= MATRIX_ROWS else None


def _top2_few(vectors: DataFrame, rows: list, excluded: DataFrame | None) -> DataFrame:
    sims = _with_excluded(vectors, excluded)
    by_dim: dict[int, list] = {}
    for r in rows:
        if r["centroid"] is not None:
            by_dim.setdefault(len(r["centroid"]), []).append(r)
    fixed = {dim: ([r["name"] for r in own], _unit([r["centroid"] for r in own])) for dim, own in by_dim.items()}
    return sims.mapInArrow(_scorer(sims.sparkSession.sparkContext.broadcast(fixed)), TOP2)  # MATRIX_ROWS at most


def _top2_many(vectors: DataFrame, identities: DataFrame, excluded: DataFrame | None) -> DataFrame:
    sims, known = _with_excluded(vectors, excluded), identities.select("name", "centroid")
    order = W.partitionBy("region_id").orderBy(F.desc("sim"), "name")
    ranked = _block_best(sims, known, 2).withColumn("second", F.lead("sim").over(order)).withColumn("_n", F.row_number().over(order)).withColumn("_x", F.sum("n_excluded").over(W.partitionBy("region_id")))
    return ranked.where("_n = 1").select("region_id", "name", "sim", "second", F.col("_x").cast("int").alias("n_excluded"))


def _with_excluded(vectors: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """region_id, embedding and the names ``excluded`` (region_id, label) for it, of vectors that are there."""
    sims = vectors.select("region_id", "embedding").where("embedding IS NOT NULL")
    if excluded is None:
        return sims.withColumn("excluded", F.lit(None).cast("array<string>"))
    return sims.join(excluded.groupBy("region_id").agg(F.collect_set("label").alias("excluded")), "region_id", "left")


def _block_best(sims: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """region_id, name and sim of the ``k`` best of each block of identities for every vector, and n_excluded (in one row of a block).

    Vectors are dealt into packs and identities into blocks; each pack meets
    each block in a group of its own, of bounded size. A vector without an
    identity in a block has a row of nulls there.
    """
    sims, known = staged(sims), staged(known.where("centroid IS NOT NULL"))
    n_packs, n_blocks = (max(1, -(-df.count() // most)) for df, most in ((sims, PACK_ROWS), (known, BLOCK_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = sims.withColumn("pack", F.pmod(F.xxhash64("region_id"), F.lit(n_packs))).withColumn("block", every(n_blocks))
    right = known.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(n_blocks))).withColumn("pack", every(n_packs))

    def best(pack: pa.Table, block: pa.Table) -> pa.Table:
        by_dim: dict[int, list[tuple[str, list]]] = {}
        for name, centroid in sorted(zip(block["name"].to_pylist(), block["centroid"].to_pylist(), strict=True)):
            by_dim.setdefault(len(centroid), []).append((name, centroid))
        fixed = {dim: ([n for n, _ in own], _unit([c for _, c in own])) for dim, own in by_dim.items()}
        out: list[tuple] = []
        for batch in pack.to_batches(max_chunksize=1024):
            ids, gone, probes = (batch.column(c).to_pylist() for c in ("region_id", "excluded", "embedding"))
            for dim in {len(p) for p in probes}:
                rows = [i for i, p in enumerate(probes) if len(p) == dim]
                names, matrix = fixed.get(dim, ([], np.zeros((0, dim))))
                place = {n: i for i, n in enumerate(names)}
                part = _unit([probes[i] for i in rows]) @ matrix.T
                hits = [[place[x] for x in gone[i] or () if x in place] for i in rows]
                for row, hit in zip(part, hits, strict=True):
                    row[hit] = -np.inf
                order = np.argsort(-part, axis=1, kind="stable")[:, :k]  # equal ones stay by name
                for i, row, hit, top in zip(rows, part, hits, order.tolist(), strict=True):
                    found = [(ids[i], names[j], float(row[j]), 0) for j in top if row[j] > -np.inf] or [(ids[i], None, None, 0)]
                    out += [(*found[0][:3], len(hit)), *found[1:]]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int32()), strict=True)], names=["region_id", "name", "sim", "n_excluded"])

    return left.groupBy("pack", "block").cogroup(right.groupBy("pack", "block")).applyInArrow(best, "region_id long, name string, sim double, n_excluded int")


def _scorer(fixed: object):
    """Arrow function that scores batches against a broadcast matrix for each dimension."""

    def score(names: list[str], matrix: np.ndarray, ids: list, vectors: list, excluded: list) -> list[tuple]:
        out, place = [], {n: i for i, n in enumerate(names)}
        for at in range(0, len(ids), 1024):
            part = _unit(vectors[at : at + 1024]) @ matrix.T
            for i, gone in enumerate(excluded[at : at + 1024]):
                hit = [place[x] for x in gone or () if x in place]
                part[i, hit] = -np.inf
                row = part[i]
                best = int(np.argmax(row))
                second = float(np.max(np.delete(row, best))) if len(row) > 1 else -np.inf
                none = row[best] == -np.inf
                out.append((ids[at + i], None if none else names[best], None if none else float(row[best]), None if second == -np.inf else second, len(hit)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out: list[tuple] = []
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(cols["embedding"]):
                groups.setdefault(len(v), []).append(i)
            for dim, rows in groups.items():
                names, matrix = fixed.value.get(dim, ([], None))
                ids = [cols["region_id"][i] for i in rows]
                if not names:
                    out += [(i, None, None, None, 0) for i in ids]
                    continue
                out += score(names, matrix, ids, [cols["embedding"][i] for i in rows], [cols["excluded"][i] for i in rows])
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in TOP2.split(", ")])

    return run


def auto_attach(vectors: DataFrame, identities: DataFrame, threshold: float = 0.5, margin: float = 0.05, auto_verify: float = 0.7, excluded: DataFrame | None = None) -> DataFrame:
    """V4. Status of every vector: matched, below, or ambiguous; a match above its identity's own threshold counts as validated.

    ``identities``: name, centroid, and sim_n, sim_mean, sim_m2 of earlier
    matches. Centroids stay as they are for the whole batch.
    """
    limit = validate_threshold(auto_verify, F.col("sim_n"), F.col("sim_mean"), F.col("sim_m2")).alias("_limit")
    few = few_rows(identities.select("name", "centroid", limit))
    if few is not None:
        found = _top2_few(vectors, few, excluded)
        limits = F.broadcast(found.sparkSession.createDataFrame([(r["name"], r["_limit"]) for r in few], "name string, _limit double"))
    else:
        found, limits = _top2_many(vectors, identities, excluded), identities.select("name", limit).hint("merge")
    joined = found.join(limits, "name", "left")
    status = F.when(F.col("sim").isNull() | (F.col("sim") < threshold), "below").when(F.col("second").isNotNull() & (F.col("sim") - F.col("second") < margin), "ambiguous").otherwise("matched")
    return joined.withColumn("status", status).withColumn("validated", (F.col("status") == "matched") & (F.col("sim") >= F.col("_limit"))).select("region_id", "name", "sim", "second", "n_excluded", "status", "validated")


def attach_histogram(attached: DataFrame) -> DataFrame:
    """A18. Matches per identity."""
    return attached.where("status = 'matched'").groupBy("name").agg(F.count("*").alias("n"), F.count_if("validated").alias("n_validated"), F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"))


def persist_attach(attached: DataFrame, vectors: DataFrame, identities: DataFrame, run_id: int, next_cluster_id: int = 1) -> dict[str, DataFrame]:
    """V5, V6. The changes that a batch of matches makes: assignments, clusters, identities, verified regions, log rows, noise to detach.

    Every centroid and running statistic is folded once, from the whole batch.
    """
    matched = staged(attached.where("status = 'matched'"))
    names = matched.select("name").distinct().withColumn("cluster_no", F.row_number().over(W.orderBy("name")) - 1)
    clusters = names.select((F.col("cluster_no") + next_cluster_id).alias("cluster_id"), F.lit(run_id).alias("run_id"), "cluster_no", F.col("name").alias("label_user"))
    means = centroids(matched.join(vectors.select("region_id", "embedding"), "region_id"), "name")
    stats = running_stats(matched, "name", "sim").select("name", F.struct(F.col("n"), F.col("mean"), F.col("m2")).alias("_s"))
    old = F.struct(F.col("sim_n").alias("n"), F.col("sim_mean").alias("mean"), F.col("sim_m2").alias("m2"))
    folded = identities.join(means.select("name", F.col("n").alias("_n"), F.col("centroid").alias("_c")).hint("merge"), "name").join(stats, "name").withColumn("_m", merge_stats(old, F.col("_s")))
    item = vectors.select("region_id", F.col("item_id") if "item_id" in vectors.columns else F.lit(None).cast("long").alias("item_id"))
    log = matched.join(item, "region_id").join(clusters.select(F.col("label_user").alias("name"), "cluster_id"), "name")
    log = log.select("region_id", "item_id", F.lit("named").alias("action"), "cluster_id", "name", F.current_timestamp().alias("created_at"))
    return {
        "clusters": clusters,
        "assignments": matched.join(clusters.select(F.col("label_user").alias("name"), "cluster_id"), "name").select("region_id", "cluster_id", (1 - F.col("sim")).alias("distance"), F.lit("cosine_dist").alias("distance_kind")),
        "identities": folded.select("name", blend(F.col("centroid"), F.col("n_samples"), F.col("_c"), F.col("_n")).alias("centroid"), (F.col("n_samples") + F.col("_n")).alias("n_samples"), F.col("_m.n").alias("sim_n"), F.col("_m.mean").alias("sim_mean"), F.col("_m.m2").alias("sim_m2")),
        "verified": matched.where("validated").select("region_id", F.lit(1).alias("user_verified")),
        "log": log,
        "detach": matched.select("region_id"),
    }


def suggest(vectors: DataFrame, identities: DataFrame, k: int = 5, excluded: DataFrame | None = None, min_sim: float | None = None, gap: float = 0.05) -> DataFrame:
    """V2, P12. The k best identities of every vector, but for rejected ones; ambiguous where the first two are close.

    More than MATRIX_ROWS identities are met in blocks, each of which gives its k + 1 best.
    """
    from filmroll.functions.scalars import cosine

    if small(identities, MATRIX_ROWS):
        pool = F.broadcast(identities.select("name", "centroid", F.size("centroid").alias("_dim")))
        pairs = vectors.select("region_id", "embedding", F.size("embedding").alias("_dim")).join(pool, "_dim").select("region_id", "name", cosine(F.col("embedding"), F.col("centroid")).alias("sim"))
        if excluded is not None:
            pairs = pairs.join(excluded.select("region_id", F.col("label").alias("name")), ["region_id", "name"], "left_anti")
    else:
        pairs = _block_best(_with_excluded(vectors, excluded), identities.select("name", "centroid"), k + 1).where("name IS NOT NULL").drop("n_excluded")
    order = W.partitionBy("region_id").orderBy(F.desc("sim"), "name")
    ranked = pairs.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_next", F.lead("sim").over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("ambiguous", (F.col("rank") == 1) & F.coalesce(F.col("sim") - F.col("_next") < gap, F.lit(False))).drop("_next")
    return ranked.where(F.col("sim") >= min_sim) if min_sim is not None else ranked


def merge_identities(identities: DataFrame, mapping: DataFrame, cap: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """V17. (merged, rejected) of merging identities by mapping (loser, survivor).

    The survivor's weight is capped; counts add up. Pairs that are equal,
    unknown or of other dimensions are rejected with the reason.
    """
    side = lambda p: identities.select(F.col("name").alias(p), F.col("centroid").alias(f"{p}_c"), F.col("n_samples").alias(f"{p}_n"))
    pairs = mapping.join(side("survivor"), "survivor", "left").join(side("loser"), "loser", "left")
    reason = F.when(F.col("survivor") == F.col("loser"), "same").when(F.col("survivor_c").isNull() | F.col("loser_c").isNull(), "missing").when(F.size("survivor_c") != F.size("loser_c"), "dimension")
    judged = pairs.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    each = good.groupBy("survivor").agg(F.first("survivor_c").alias("c"), F.first("survivor_n").alias("n"), F.collect_list(F.struct(F.col("loser_c").alias("c"), F.col("loser_n").alias("n"))).alias("losers"))
    weight = F.least(F.col("n"), F.lit(cap)) if cap is not None else F.col("n")
    total = F.aggregate("losers", F.transform("c", lambda x: x * weight), lambda acc, x: F.zip_with(acc, x["c"], lambda a, b: a + b * x["n"]))
    more = F.aggregate("losers", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    merged = each.select(F.col("survivor").alias("name"), F.transform(total, lambda x: x / (weight + more)).alias("centroid"), (F.col("n") + more).alias("n_samples"))
    return merged, judged.where("reason IS NOT NULL").select("survivor", "loser", "reason")
