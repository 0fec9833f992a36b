"""Reading, writing and changing catalog tables; a change is a new DataFrame, never an update in place."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window as W

from filmroll.schema import CHILDREN, TABLES, VECTOR


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """S6. A table with its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """S6. Write a table to a new folder; facts are best partitioned by run_id or model_name."""
    writer = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")


@F.pandas_udf(VECTOR)
def unpack_vector(raw: pd.Series) -> pd.Series:
    """S7. Little-endian float32 bytes to a vector; null and empty bytes to null."""
    return raw.map(lambda b: np.frombuffer(b, dtype="<f4") if b else None)


@F.pandas_udf(BinaryType())
def pack_vector(vector: pd.Series) -> pd.Series:
    """S7. A vector to little-endian float32 bytes."""
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), ignore: bool = False, order: Column | None = None) -> DataFrame:
    """S8. ``base`` with the rows of ``delta`` inserted or replacing those of equal keys.

    ``keep_old`` columns keep a value that is not null; ``ignore`` keeps
    existing rows as they are. Among delta rows of one key the last by ``order`` wins.
    """
    ranked = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.col("_new"), *([order] if order is not None else []))
    best = F.min_by if ignore else F.max_by
    rest = [c for c in base.columns if c not in keys]
    picked = ranked.groupBy(*keys).agg(
        best(F.struct(*rest), rank).alias("_row"),
        *[F.max(F.when(F.col("_new") == 0, F.col(c))).alias(f"_old_{c}") for c in keep_old],
    )
    value = lambda c: F.coalesce(F.col(f"_old_{c}"), F.col(f"_row.{c}")) if c in keep_old else F.col(f"_row.{c}")
    return picked.select(*[F.col(c) if c in keys else value(c).alias(c) for c in base.columns])


def replace_slice(base: DataFrame, delta: DataFrame, slice_keys: list[str]) -> DataFrame:
    """S9. Drop the slices of ``base`` that ``delta`` has rows of, then add ``delta``."""
    return base.join(delta.select(*slice_keys).distinct(), slice_keys, "left_anti").unionByName(delta.select(*base.columns))


def cascade_delete(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """S10. Delete the rows of table ``name`` with these keys, and all rows below them; the log stays."""
    out = dict(tables)
    if name not in out:
        return out
    on = keys.columns
    gone = out[name].join(keys, on, "left_semi")
    out[name] = out[name].join(keys, on, "left_anti")
    for child, column in CHILDREN.get(name, []):
        if child in out:
            out = cascade_delete(out, child, gone.select(column).where(F.col(column).isNotNull()).distinct())
    return out


def purge(tables: dict[str, DataFrame], keep_identities: bool = True) -> dict[str, DataFrame]:
    """S11. Empty the region tables, and identities and log unless they are kept."""
    names = {"regions", "assignments"} | (set() if keep_identities else {"identities", "corrections"})
    return {n: (t.limit(0) if n in names else t) for n, t in tables.items()}


def allocate(delta: DataFrame, existing: DataFrame, column: str, within: list[str], order: list[str]) -> DataFrame:
    """W6. Number new rows on from the largest number there is, per ``within``."""
    top = existing.groupBy(*within).agg(F.max(column).alias("_top"))
    place = F.row_number().over(W.partitionBy(*within).orderBy(*order))
    return delta.join(top, within, "left").withColumn(column, F.coalesce(F.col("_top"), F.lit(-1)) + place).drop("_top")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames of one shape."""
    return reduce(DataFrame.unionByName, frames)
