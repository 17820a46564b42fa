"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder only where that is unset in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("veritext.shared.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veritext-")
        spark.conf.set("veritext.shared.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` as a table: written once and read back, so that later steps don't repeat the work or depend on executors.

    ``release``: for large tables, the shuffle files behind the write go when it ends, and the table is compressed more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if not release:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: Column, name: str = "slot", ranked: int = 20_000) -> DataFrame:
    """``df`` with a dense number from 0 in the order of a hash of ``key`` (unique).

    Rows are counted by the hash's first bits, as many as leave about ``ranked`` rows to a range, and
    ranked inside the ranges. The number doesn't depend on the ranges.
    """
    h = F.xxhash64(key)
    bits = max(6, min(30, (df.count() // ranked).bit_length()))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 64 - bits))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_b").count().withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_b", "_o")
    inside = Window.partitionBy("_b").orderBy("_h", key)
    out = rows.join(counts, "_b").withColumn(name, F.col("_o") + F.row_number().over(inside) - 1)
    return out.drop("_h", "_b", "_o")
