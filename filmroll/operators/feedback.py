"""The correction log: what people said, kept for good and applied again to every new clustering."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.operators.people import NOISE
from filmroll.sources.staging import small, staged

#: Regions of a block of one label, pairs of regions that a task makes, and labels up to which their sizes are sent to every executor.
BLOCK_REGIONS, TASK_PAIRS, LABEL_ROWS = 512, 1 << 22, 200_000


def corrections(log: DataFrame, actions: list[str] | None = None, region_id: int | None = None, limit: int | None = None) -> DataFrame:
    """P5. Log rows by action and region, newest first."""
    if actions:
        log = log.where(F.col("action").isin(actions))
    if region_id is not None:
        log = log.where(F.col("region_id") == region_id)
    ordered = log.orderBy(F.desc("id"))
    return ordered.limit(limit) if limit is not None else ordered


def compact_log(log: DataFrame) -> DataFrame:
    """A14. Every unassignment, and of all else the newest row per region and action.

    The newest id is an aggregate, not a window, so that one region with a long
    history is summed up where its rows are.
    """
    region = F.coalesce("region_id", F.lit(-1))
    newest = log.where("action <> 'unassigned'").groupBy(region.alias("_r"), "action").agg(F.max("id").alias("id"))
    return log.where("action = 'unassigned'").unionByName(log.join(newest.select("id"), "id", "left_semi").select(*log.columns))


def cannot_link(log: DataFrame, clusters: DataFrame) -> DataFrame:
    """J8. region_id and the label of each cluster it was taken out of."""
    taken = log.where("action = 'unassigned' AND region_id IS NOT NULL").select("region_id", "cluster_id").distinct()
    return taken.join(clusters.where("label_user IS NOT NULL").select("cluster_id", "label_user"), "cluster_id").select("region_id", F.col("label_user").alias("label")).distinct()


def latest_intent(log: DataFrame) -> DataFrame:
    """W8. The newest naming or unassignment of each region."""
    pool = log.where("action IN ('named', 'unassigned') AND region_id IS NOT NULL")
    newest = pool.groupBy("region_id").agg(F.max("id").alias("id"))
    return pool.join(newest, ["region_id", "id"])


def must_links(log: DataFrame) -> DataFrame:
    """J16. Regions of one name, each tied to the least."""
    named = latest_intent(log).where("action = 'named' AND name IS NOT NULL").select("region_id", "name")
    least = named.groupBy("name").agg(F.min("region_id").alias("src"))
    return named.join(least, "name").where("region_id <> src").select("src", F.col("region_id").alias("dst")).distinct()


def rejections(log: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J17, unpaired. (region_id, label) of names that regions rejected, and of the names that regions have.

    As many rows as the log has at most, where the pairs of ``cannot_links``
    grow with the square of a name's regions; ``apply_constraints`` takes either.
    """
    named = latest_intent(log).where("action = 'named' AND name IS NOT NULL").select("region_id", F.col("name").alias("label")).distinct()
    return cannot_link(log, clusters), named


def _pairs_by_label(rejected: DataFrame, named: DataFrame) -> DataFrame:
    """src and dst of every pair of a rejection and a naming (region_id, label; distinct rows) of one label.

    Both sides of a label are dealt into blocks, and every pair of blocks is a
    row that is spread over the tasks on its own, so neither a hot label nor their
    small number holds a task up; tasks are as many as the pairs ask for.
    """
    blocks = lambda df, n: df.groupBy("label").agg(F.count("*").alias(n))
    sizes = staged(blocks(rejected, "n_src").join(blocks(named, "n_dst").hint("merge"), "label"))
    pairs = sizes.agg(F.sum(F.col("n_src").cast("double") * F.col("n_dst"))).first()[0] or 0.0
    n_tasks = math.ceil((pairs + 1) / TASK_PAIRS)
    counted = sizes.select("label", *[F.ceil(F.col(n) / BLOCK_REGIONS).alias(n) for n in ("n_src", "n_dst")]).hint("broadcast" if small(sizes, LABEL_ROWS) else "merge")

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        dealt = df.join(counted, "label").withColumn(own, F.pmod(F.xxhash64("region_id"), F.col(f"n_{own}")))
        stored = staged(dealt.groupBy("label", own, f"n_{other}").agg(F.collect_list("region_id").alias(f"{own}s")))
        met = stored.select("label", own, f"{own}s", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(other))
        return met.repartition(n_tasks, "label", "src", "dst")

    met = side(rejected, "src", "dst").join(side(named, "dst", "src").hint("merge"), ["label", "src", "dst"])
    return met.select(F.explode("srcs").alias("src"), "dsts").select("src", F.explode("dsts").alias("dst")).where("src <> dst")


def cannot_links(log: DataFrame, clusters: DataFrame) -> DataFrame:
    """J17. A region that rejected a name, against every region of that name: all pairs.

    A region has one name, so its pairs are distinct as they are; only where a
    log repeats an id, and so a region has several names, they are told apart.
    """
    rejected, named = map(staged, rejections(log, clusters))
    names = staged(named.groupBy("region_id").agg(F.collect_list("label").alias("labels")))
    pairs = _pairs_by_label(rejected, names.where(F.size("labels") == 1).select("region_id", F.col("labels")[0].alias("label")))
    several = names.where(F.size("labels") > 1).select("region_id", F.explode("labels").alias("label"))
    return pairs if several.isEmpty() else pairs.union(_pairs_by_label(rejected, several).distinct())


def apply_constraints(edges: DataFrame, must: DataFrame, cannot: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """V13. Edges (src, dst, weight) with must-links at weight 0 and cannot-links taken out; the latter win.

    ``cannot`` are pairs (src, dst), or ``rejections``, which edges are held against by label.
    """
    pair = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    sorted_edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    joined = sorted_edges.unionByName(pair(must).withColumn("weight", F.lit(0.0))).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    if isinstance(cannot, tuple):
        rejected, named = cannot
        both = joined.select("src", "dst").union(joined.select("dst", "src")).where("src <> dst")
        labelled = both.join(named.select(F.col("region_id").alias("dst"), "label"), "dst")
        cannot = labelled.join(rejected.select(F.col("region_id").alias("src"), "label"), ["src", "label"], "left_semi")
    return joined.join(pair(cannot).distinct(), ["src", "dst"], "left_anti")


def replay_corrections(log: DataFrame, assignments: DataFrame, clusters: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """V14. Assignments and cluster labels of a run after the log is applied to it again.

    A region whose newest intent is an unassignment moves to noise, if the run
    has noise; the oldest of the newest namings in a cluster labels it; noise
    is never labelled.
    """
    own, run = assignments.where(F.col("run_id") == run_id), clusters.where(F.col("run_id") == run_id)
    intent = latest_intent(log).select("region_id", "id", "action", "name")
    has_noise = run.where(F.col("cluster_no") == NOISE).select(F.col("run_id")).distinct().withColumn("_noise", F.lit(True))
    placed = own.join(intent, "region_id", "left").join(has_noise, "run_id", "left")
    out = F.coalesce((F.col("action") == "unassigned") & F.col("_noise"), F.lit(False))
    moved = placed.select("region_id", "run_id", F.when(out, NOISE).otherwise(F.col("cluster_no")).alias("cluster_no"), F.when(out, 0.0).otherwise(F.col("distance")).alias("distance"))
    labels = placed.where("action = 'named' AND name IS NOT NULL").where(F.col("cluster_no") != NOISE).groupBy("cluster_no").agg(F.min_by("name", "id").alias("_label"))
    named = run.join(labels, "cluster_no", "left").withColumn("label_user", F.coalesce("_label", "label_user")).select(*clusters.columns)
    return moved, named


#: What an action speaks to. Naming a region confirms it as well.
FAMILIES = {"verified": ("check",), "unverified": ("check",), "named": ("check", "name"), "unassigned": ("name",), "deleted": ("deleted",)}
NEWEST = "region_id long, family string, id long, action string, name string, cluster_id long"


def newest_actions(log: DataFrame) -> DataFrame:
    """V20. region_id, family, id, action, name and cluster_id: the newest action of each family of a region."""
    families = F.create_map(*[x for a, own in FAMILIES.items() for x in (F.lit(a), F.array(*map(F.lit, own)))])
    each = log.where("region_id IS NOT NULL").select("region_id", F.explode(F.element_at(families, F.col("action"))).alias("family"), F.struct("id", "action", "name", "cluster_id").alias("a"))
    return each.groupBy("region_id", "family").agg(F.max_by("a", "a.id").alias("a")).select("region_id", "family", "a.*")


def apply_newest(regions: DataFrame, newest: DataFrame) -> dict[str, DataFrame]:
    """V20. What :func:`newest_actions` of a log change: regions (confirmed, doubted, deleted), and the rows to delete, unassign and name."""
    checks = newest.where("family = 'check'").select("region_id", F.when(F.col("action") != "unverified", 1).alias("_v"), F.lit(True).alias("_hit"))
    gone = newest.where("family = 'deleted'").select("region_id")
    kept = regions.join(gone.hint("merge"), "region_id", "left_anti").join(checks.hint("merge"), "region_id", "left")
    return {
        "regions": kept.withColumn("user_verified", F.when(F.col("_hit"), F.col("_v")).otherwise(F.col("user_verified"))).select(*regions.columns),
        "deleted": gone,
        "unassigned": newest.where("action = 'unassigned'").select("region_id", "cluster_id"),
        "named": newest.where("action = 'named' AND family = 'name'").select("region_id", "name"),
    }


def apply_actions(regions: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """V20. Regions after a batch of actions, the newest of each family counting.

    Verifying or naming a region confirms it (1), unverifying takes that back
    (null). Also the rows to delete, unassign and name, and ``log``, the audit rows to
    append: one for each action on a region there is.
    """
    known = regions.select("region_id", F.col("item_id") if "item_id" in regions.columns else F.lit(None).cast("long").alias("item_id"))
    audit = log.join(known, "region_id").select("id", "region_id", "item_id", "action", "cluster_id", "name")
    return apply_newest(regions, newest_actions(log)) | {"log": audit}


def unassign(assignments: DataFrame, regions: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """V19. Assignments without these regions in one run, and the log rows that say so."""
    hit = assignments.where(F.col("run_id") == run_id).join(regions.select("region_id"), "region_id", "left_semi")
    rest = assignments.join(hit.select("region_id", "run_id", "cluster_no"), ["region_id", "run_id", "cluster_no"], "left_anti")
    return rest, hit.select("region_id", F.lit("unassigned").alias("action"), "run_id", "cluster_no")


def detach_from_noise(assignments: DataFrame, regions: DataFrame) -> DataFrame:
    """V19. Assignments without those of these regions to noise."""
    hit = assignments.where(F.col("cluster_no") == NOISE).join(regions.select("region_id"), "region_id", "left_semi").select("region_id", "run_id", "cluster_no")
    return assignments.join(hit, ["region_id", "run_id", "cluster_no"], "left_anti")


def clear_noise_labels(clusters: DataFrame) -> DataFrame:
    """V18. Noise has no label."""
    return clusters.withColumn("label_user", F.when(F.col("cluster_no") != NOISE, F.col("label_user")))


def rename_label(clusters: DataFrame, mapping: DataFrame) -> DataFrame:
    """V16. Labels replaced by mapping (old, new), an empty new one clearing it; noise is left alone."""
    joined = clusters.join(mapping.select(F.col("old").alias("label_user"), F.col("new").alias("_new"), F.lit(True).alias("_hit")), "label_user", "left")
    new = F.when(F.col("_hit") & (F.col("cluster_no") != NOISE), F.nullif("_new", F.lit(""))).otherwise(F.col("label_user"))
    return joined.withColumn("label_user", new).select(*clusters.columns)


def rename_identities(identities: DataFrame, mapping: DataFrame) -> DataFrame:
    """V16. Identities (name, centroid, n_samples) after renames (old, new): moved to a new name, or merged where that one exists.

    A name that is cleared (null or empty) loses its identity.
    """
    cleared = mapping.where("new IS NULL OR new = ''").select(F.col("old").alias("name"))
    identities = identities.join(cleared, "name", "left_anti")
    wanted = mapping.where("new IS NOT NULL AND new <> '' AND old <> new").select("old", "new").join(identities.select(F.col("name").alias("old")), "old", "left_semi")
    targets = wanted.groupBy("new").agg(F.collect_set("old").alias("olds"))
    # a name that several take over, or that exists, is a mean of all that come together there, by their samples
    renamed = identities.join(wanted.select(F.col("old").alias("name"), F.col("new").alias("_new")), "name", "left").withColumn("name", F.coalesce("_new", "name"))
    touched = renamed.join(targets.select(F.col("new").alias("name")), "name", "left_semi").select("name", "centroid", "n_samples")
    sums = touched.select("name", "n_samples", F.posexplode("centroid").alias("pos", "x")).groupBy("name", "pos").agg((F.sum(F.col("x") * F.col("n_samples")) / F.sum("n_samples")).alias("x"))
    merged = sums.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))
    counts = touched.groupBy("name").agg(F.sum("n_samples").alias("n_samples"))
    rest = renamed.join(targets.select(F.col("new").alias("name")), "name", "left_anti").select("name", "centroid", "n_samples")
    return rest.unionByName(merged.hint("merge").join(counts, "name").select("name", "centroid", "n_samples"))


def name_clusters(clusters: DataFrame, mapping: DataFrame, members: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """V15. Labels set or cleared in bulk by mapping (cluster_id, label; null or empty clears), noise refused.

    Returns clusters, identities and rejected (cluster_id, reason). The identity
    of a label that is set becomes the mean of the ``members`` (cluster_id,
    embedding) of the clusters that get it, and its statistics start anew.
    """
    from filmroll.operators.vectors import centroids

    wanted = mapping.groupBy("cluster_id").agg(F.max_by(F.nullif("label", F.lit("")), F.coalesce("label", F.lit(""))).alias("_label")).withColumn("_hit", F.lit(True))
    judged = wanted.join(clusters.select("cluster_id", "cluster_no"), "cluster_id", "left").withColumn("reason", F.when(F.col("cluster_no").isNull(), "unknown cluster").when(F.col("cluster_no") == NOISE, "noise"))
    applied = judged.where("reason IS NULL").select("cluster_id", "_label", "_hit")
    named = clusters.join(applied, "cluster_id", "left").withColumn("label_user", F.when(F.col("_hit"), F.col("_label")).otherwise(F.col("label_user"))).select(*clusters.columns)
    means = centroids(members.join(applied.where("_label IS NOT NULL"), "cluster_id").select(F.col("_label").alias("name"), "embedding"), "name")
    fresh = means.select("name", "centroid", F.col("n").alias("n_samples"), F.lit(0).cast("long").alias("sim_n"), F.lit(0.0).alias("sim_mean"), F.lit(0.0).alias("sim_m2"))
    kept = identities.join(fresh.select("name").hint("merge"), "name", "left_anti").select(*fresh.columns)
    return {"clusters": named, "identities": kept.unionByName(fresh), "rejected": judged.where("reason IS NOT NULL").select("cluster_id", "reason")}


def read_mapping(texts: DataFrame, column: str) -> DataFrame:
    """S15. key, value and is_text of the entries of JSON objects such as {"17": "Anne"}; texts that are no JSON give none."""
    parsed = texts.select(F.try_parse_json(column).alias("_json")).where("_json IS NOT NULL")
    entries = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_json").outer()))
    return entries.select("key", F.try_variant_get("value", "$", "string").alias("value"), (F.schema_of_variant("value").isin("STRING", "VOID")).alias("is_text"))


def rename_bulk(clusters: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S15. (applied, rejected) of a mapping of cluster ids to labels (key, value: both text; null or empty clears; is_text, if there, tells values that were none)."""
    probed = mapping.withColumn("cluster_id", F.col("key").try_cast("long"))
    joined = probed.join(clusters.select("cluster_id", F.lit(True).alias("_known"), "cluster_no").hint("merge"), "cluster_id", "left")
    reason = F.when(F.col("cluster_id").isNull(), "not a number").when(F.col("_known").isNull(), "unknown cluster").when(F.col("cluster_no") == NOISE, "noise")
    if "is_text" in mapping.columns:
        reason = reason.when(~F.col("is_text"), "not a text")
    judged = joined.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("cluster_id", F.nullif("value", F.lit("")).alias("label")), judged.where("reason IS NOT NULL").select("key", "reason")


def intent_windows(log: DataFrame) -> DataFrame:
    """Place of every log row in the history of its region."""
    return log.withColumn("place", F.row_number().over(W.partitionBy("region_id").orderBy("id")))
