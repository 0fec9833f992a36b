"""Tables that change in place, a hash bucket at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from filmroll.sources.staging import staged
from filmroll.sources.tables import upsert


@dataclass(frozen=True)
class BucketTable:
    """A table under ``path``, partitioned by a hash bucket of its ``keys``.

    A change reads and writes the buckets that its rows fall into and no
    other; the files of these buckets are replaced and the old ones removed. A
    change that is made again from the same rows gives the same table, so an
    interrupted one is mended by running it again. One writer at a time.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    n_buckets: int = 64

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int").alias("bucket")

    def create(self, rows: DataFrame) -> None:
        """Write a first version; there must be none."""
        rows.select(*self.schema.names, self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def ensure(self, spark: SparkSession) -> None:
        """Make an empty table where there is none."""
        spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).write.mode("ignore").partitionBy("bucket").parquet(self.path)

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).option("ignoreMissingFiles", True).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows."""
        return self._all(spark).drop("bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows (with the keys) fall into: ``n_buckets`` numbers at most."""
        return sorted(r["bucket"] for r in rows.select(self.bucket()).distinct().collect())

    def rewrite(self, buckets: list[int], rows: DataFrame) -> None:
        """Replace these buckets by ``rows``, which must lie in them; buckets that get no row stay with none."""
        spark = rows.sparkSession
        if not buckets:
            return
        marked = staged(rows.select(*self.schema.names, self.bucket()))  # read before anything is replaced
        marked.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        left = sorted(set(buckets) - {r["bucket"] for r in marked.select("bucket").distinct().collect()})
        for b in left:  # dynamic overwriting keeps a bucket that has no new row, so it is emptied by an empty file
            spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bucket={b}")

    def slice(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; only their folders are read."""
        return self._all(spark).where(F.col("bucket").isin(buckets)).drop("bucket")

    def upsert(self, delta: DataFrame, order: Column | None = None, **options) -> list[int]:
        """S8. :func:`upsert` on the buckets of ``delta``; returns these."""
        delta = staged(delta)
        buckets = self.touched(delta)
        if buckets:
            self.rewrite(buckets, upsert(self.slice(delta.sparkSession, buckets), delta, list(self.keys), order=order, **options))
        return buckets

    def replace_slice(self, delta: DataFrame) -> list[int]:
        """S9. Rows of equal keys go out and ``delta`` comes in; ``keys`` are the slice."""
        delta = staged(delta)
        buckets = self.touched(delta)
        kept = self.slice(delta.sparkSession, buckets).join(delta.select(*self.keys).distinct().hint("merge"), list(self.keys), "left_anti")
        self.rewrite(buckets, kept.unionByName(delta.select(*self.schema.names)))
        return buckets

    def delete(self, gone: DataFrame) -> list[int]:
        """S10. Rows with the keys of ``gone`` go out; returns their buckets."""
        gone = staged(gone.select(*self.keys).distinct())
        buckets = self.touched(gone)
        self.rewrite(buckets, self.slice(gone.sparkSession, buckets).join(gone.hint("merge"), list(self.keys), "left_anti"))
        return buckets
