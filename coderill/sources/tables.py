"""Parquet tables of one corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` as stored."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """One row per ``key``: the one delivered last (ties by content).  Rows with a null key are kept as one group.

    Repeated deliveries are few, so the aggregate reduces little before its shuffle; call it after projecting the
    columns that are needed and after filtering."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(*([F.col(at)] if at in rest else []), F.xxhash64(*[F.col(c) for c in rest if c != at] or [F.lit(0)]))
    row = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col("_row")[c].alias(c) for c in rest])
