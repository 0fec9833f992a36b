"""Operator 2, mixing sources to target weights as a time-varying curriculum.

Every source has a weight that changes over training time. The integral of its
schedule gives its target; the inverse of the cumulative demand turns a
document's place in its source's stream into a training position; documents
are then range-sorted by position.

Places are running sums of sizes. A source may hold most of the rows, so no
window spans a source: documents fall into hash buckets of their source, the
small table of bucket sums gives every bucket its offset, and windows stay
inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import WORD, documents, materialize, put_back, set_aside, sized_hint

#: (time, factor) knots of a source's weight over training, linear between knots; sources take them in turn.
RISING = ((0.0, 0.5), (1.0, 1.5))
FALLING = ((0.0, 1.5), (1.0, 0.5))
SCHEDULES = (RISING, FALLING)
WEIGHTS = (5, 2, 1)


def integral(schedule: tuple[tuple[float, float], ...]) -> float:
    """Area under a piecewise linear schedule."""
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False))


def invert_demand(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the schedule's cumulative demand reaches ``share`` (0 to 1) of its integral."""
    demand, found, before = share * integral(schedule), None, 0.0
    for (t0, a), (t1, b) in zip(schedule, schedule[1:], strict=False):
        rest, slope = demand - before, (b - a) / (t1 - t0)
        at = F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0)))), F.lit(0.0))
        before += (t1 - t0) * (a + b) / 2
        found = F.when(demand <= before, at) if found is None else found.when(demand <= before, at)
    return found.otherwise(F.lit(schedule[-1][0]))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """Per source of ``sizes`` (source_key, source, source_size): its turn, and its target in words.

    A source's weight is its base weight times the integral of its schedule.
    Targets share ``share`` times all sizes by weight; none exceeds ``most``
    times its source, and what is cut is shared again by weight. With sources
    in order of the level at which they are cut, that level has a closed form.
    """
    whole = W.partitionBy(F.lit(0))
    turn = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("turn") % len(values))
    rated = sizes.withColumn("turn", turn).withColumn("weight", at(weights) * at([integral(s) for s in schedules]))
    rated = rated.withColumn("ceiling", most * F.col("source_size")).withColumn("cut_level", F.col("ceiling") / F.col("weight"))
    by_level = whole.orderBy("cut_level", "turn")
    rated = rated.withColumns(
        {
            "left": share * F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest_weight": F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", F.col("left") / F.col("rest_weight"))
    level = F.min(F.when(F.col("level") <= F.col("cut_level"), F.struct("cut_level", "turn", "level"))).over(whole)["level"]
    return rated.select("source_key", "source_size", "turn", F.least(F.col("ceiling"), F.coalesce(F.col("weight") * level, F.col("ceiling"))).alias("target"))


def _position(start: Column, schedules: tuple) -> Column:
    """Training position of the place ``start`` in the stream of the row's source."""
    share_at = F.coalesce(F.try_divide(start.cast("double"), F.col("target")), F.lit(0.0))
    position = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        position = F.when(F.col("turn") % len(schedules) == k, invert_demand(share_at, schedule)).otherwise(position)
    return position


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source), sorted by training position.

    Returns doc_id, source, size (words; null text: 0), source_size, target,
    turn (the source's rank), taken (words, at most ``most`` times size), start (the document's place in
    its source's stream, which is read again from the front when it ends) and
    position (first training position, 0 to 1; null if nothing is taken).
    Order within a source follows a hash of doc_id, so reruns agree. Null
    sources form one source, ranked last; repeated rows count each; an empty
    table gives no rows.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("source_key"),
            key.alias("order_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    ).withColumn("bucket", F.substring("order_key", 1, 3))
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    buckets = materialize(buckets)
    totals = buckets.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    before = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(source_targets(totals, weights, share, most, schedules).hint("merge"), "source_key")
    inside = W.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(offsets.hint("merge"), ["source_key", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal, none = F.floor(F.col("target") + 0.5), F.lit(0)
    passes = [F.greatest(none, F.least("size", goal - F.col("start") - k * F.col("source_size"))) for k in range(int(-(-most // 1)))]
    position = _position(F.col("start"), schedules)
    taken = placed.withColumn("taken", sum(passes[1:], passes[0]).cast("long"))
    taken = taken.withColumn("position", F.when(F.col("taken") > 0, F.round(position, 9)))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "start", "turn", "position").orderBy("position", "doc_id")


def curriculum(docs: DataFrame, schedules: tuple = SCHEDULES, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, as often as the mix takes them, in training order.

    A row is repeated once for each copy taken, each at its own position; the
    document at the end of a source's quota stays whole if at least half of it
    is taken. Rows without words, null texts among them, are left out: the mix
    takes nothing of them. Very long texts are counted and taken whole. Columns
    as in ``docs``, with any names; rows of one doc_id and size, repeated ones
    too, are taken as often as the one taken most; an empty table gives no rows.
    """
    copies = (F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = mix(docs, schedules=schedules, **options).where("taken > 0").withColumn("copies", copies).where("copies > 0")
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.col("start") + k * F.col("source_size"))
    placed = mixed.groupBy(F.col("doc_id").alias("id"), "size").agg(F.max_by(F.struct("source_size", "target", "turn", at.alias("at")), "copies").alias("m"))
    placed = placed.select("id", "size", F.col("m.target").alias("target"), F.col("m.turn").alias("turn"), F.explode("m.at").alias("at"))
    placed = placed.select("id", "size", _position(F.col("at"), schedules).alias("at")).groupBy("id", "size").agg(F.collect_list("at").alias("at"))
    sized = set_aside(docs, "doc_id", "text").withColumn("words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    chosen = sized.join(sized_hint(materialize(placed)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("words") == F.col("size")))
    ordered = chosen.withColumn("at", F.explode("at")).orderBy("at", "doc_id").select("doc_id", "text", "rest")
    return ordered.select(*put_back(ordered, docs.columns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 and 150 % of all words."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
rated AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM totals),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS ceiling FROM rated),
levels AS (
  SELECT *, ceiling / weight AS cut_level,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ceiling / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
found AS (SELECT level FROM levels WHERE level <= cut_level ORDER BY cut_level, turn LIMIT 1),
targets AS (
  SELECT source, source_size, turn, least(ceiling, coalesce(weight * (SELECT level FROM found), ceiling)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, turn, target, floor(target + 0.5::DOUBLE) AS goal,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) AS BIGINT) AS taken,
         coalesce(CAST(start AS DOUBLE) / nullif(target, 0), 0.0::DOUBLE) AS u
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN u > 1 THEN 1.0::DOUBLE
            WHEN turn % 2 = 0 THEN 2 * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * u))
            ELSE 2 * u / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * u)) END, 9) END AS position
FROM taken
"""

QUERIES = {"op2_source_mix": op2_source_mix}
ORACLE_SQL = {"op2_source_mix": OP2_SQL}
