"""Writing intermediate results where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back; a temporary folder serves only a session of one process, as in tests."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="filmroll-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; stops counting beyond."""
    return df.limit(rows + 1).count() <= rows
