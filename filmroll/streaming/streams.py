"""The catalog as streams: ingest, deduplication, running statistics, corrections, attachment and rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from filmroll.operators.feedback import FAMILIES, NEWEST, apply_newest
from filmroll.operators.vectors import auto_attach, persist_attach
from filmroll.sources.buckets import BucketTable
from filmroll.sources.files import classify_changes, observe_counts
from filmroll.sources.staging import staged


def stream_ingest(listing: DataFrame, table: BucketTable, checkpoint: str, report: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """T1. Keep a table of files (path, mtime, hash), keyed by path, up to date.

    A batch rewrites only the buckets its new and changed files fall into, and
    gives the same table if it runs again. ``report`` gets the batch's number and
    its counts by status, observed while the changes are written (A23).
    """
    table.ensure(listing.sparkSession)

    def take(batch: DataFrame, batch_id: int) -> None:
        newest = staged(batch.groupBy("path").agg(F.max_by(F.struct("mtime", "hash"), "mtime").alias("f")).select("path", "f.*"))
        known = table.slice(batch.sparkSession, table.touched(newest))
        status = classify_changes(newest, known, newest).where("status <> 'missing'")
        counted, counts = observe_counts(status)
        changed = staged(counted.join(newest.hint("merge"), "path").select("path", "mtime", "hash", "status"))
        table.upsert(changed.where("status <> 'unchanged'").drop("status"))
        if report:
            report(batch_id, counts.get)

    return listing.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(files: DataFrame, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """T2. The first of equal rows within a watermark."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class IdentityStats(StatefulProcessor):
    """T3. Count, mean and squared deviations of an identity's similarities, whatever order they come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stats", "n long, mean double, m2 double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        for frame in rows:
            for x in frame["sim"]:
                n += 1
                delta = x - mean
                mean += delta / n
                m2 += delta * (x - mean)
        self.state.update((n, mean, m2))
        yield pd.DataFrame({"name": [key[0]], "n": [n], "mean": [mean], "m2": [m2]})

    def close(self) -> None:
        pass


def stream_identity_stats(sims: DataFrame) -> DataFrame:
    """T3. Running statistics of (name, sim); needs the RocksDB state store."""
    return sims.groupBy("name").transformWithStateInPandas(IdentityStats(), "name string, n long, mean double, m2 double", "Update", "None")


class NewestActions(StatefulProcessor):
    """T4. The newest id of each action family of a region; passes on the actions that become the newest, so late ones are lost."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "check long, name long, deleted long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        families = ("check", "name", "deleted")
        seen = dict(zip(families, self.seen.get() if self.seen.exists() else (None,) * 3, strict=True))
        new: dict[str, tuple] = {}
        for frame in rows:
            for id_, action, name, cluster in frame[["id", "action", "name", "cluster_id"]].itertuples(index=False):
                for family in FAMILIES.get(action, ()):
                    if seen[family] is None or id_ > seen[family]:
                        seen[family] = int(id_)
                        new[family] = (int(key[0]), family, int(id_), action, name if isinstance(name, str) else None, None if pd.isna(cluster) else int(cluster))
        self.seen.update(tuple(seen[f] for f in families))
        if new:
            frame = pd.DataFrame(list(new.values()), columns=["region_id", "family", "id", "action", "name", "cluster_id"])
            yield frame.astype({"cluster_id": "Int64"})

    def close(self) -> None:
        pass


def stream_newest_actions(log: DataFrame) -> DataFrame:
    """T4. Actions (id, region_id, action, cluster_id, name) that are the newest of their family so far, by region; needs the RocksDB state store."""
    return log.where("region_id IS NOT NULL").groupBy("region_id").transformWithStateInPandas(NewestActions(), NEWEST, "Update", "None")


def stream_apply_actions(log: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """T4. Keep the table of regions, keyed by region_id, up to date with a stream of corrections in any order.

    The state holds the newest id of each family, so the table is what
    ``apply_actions`` makes of the whole log, however it is cut and mixed. Only
    buckets with changes are rewritten; a batch that runs again changes nothing more.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        newest = staged(batch)
        buckets = table.touched(newest)
        table.rewrite(buckets, apply_newest(table.slice(batch.sparkSession, buckets), newest)["regions"])

    return stream_newest_actions(log).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Snapshots of the identities that are kept; a batch reads the one before its own.
SNAPSHOTS = 3


def snapshot(spark: SparkSession, root: str, batch_id: int, schema: object) -> DataFrame:
    """T5. The identities after a batch, -1 being those at the start; only the last SNAPSHOTS are kept."""
    return spark.read.schema(schema).parquet(f"{root}/identities/slot={batch_id % SNAPSHOTS}")


def stream_attach(vectors: DataFrame, identities: DataFrame, root: str, checkpoint: str, run_id: int = 0, **options) -> StreamingQuery:
    """T5. Match each batch of new vectors against the identities as the batch before left them, and fold its matches in.

    Under ``root``: matches/batch=n, and identities/slot=k with the snapshot after
    a batch. A batch reads the snapshot before it and writes its own two
    folders, both from that alone, so a batch that runs again changes nothing.
    """
    identities.write.mode("ignore").parquet(f"{root}/identities/slot={-1 % SNAPSHOTS}")
    schema = identities.schema

    def take(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, staged(batch)
        known = snapshot(spark, root, batch_id - 1, schema)
        attached = staged(auto_attach(own, known, **options))
        folded = persist_attach(attached, own, known, run_id)["identities"]
        after = known.join(folded.select("name").hint("merge"), "name", "left_anti").unionByName(folded.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))
        after.write.mode("overwrite").parquet(f"{root}/identities/slot={batch_id % SNAPSHOTS}")
        attached.write.mode("overwrite").parquet(f"{root}/matches/batch={batch_id}")

    return vectors.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_action_rates(log: DataFrame, time: str = "ts", window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """T6. Actions per tumbling or sliding window."""
    by = F.window(time, window, slide) if slide else F.window(time, window)
    return log.withWatermark(time, delay).groupBy(by, "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def stream_sessions(log: DataFrame, user: str, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """T6. Sessions of a user: runs of actions with no longer gap."""
    return log.withWatermark(time, delay).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
