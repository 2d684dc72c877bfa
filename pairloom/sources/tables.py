"""Parquet tables of a data folder, and the rule of which rows are one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str, limit: int | None = None) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` if any are given, so that the scan reads no others; ``limit`` rows for trials."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per value of ``key``; repeated arrivals hold the same values, so any of them stands for all.

    Rows whose key is null can't be told to be the same record; each stays a record of its own.
    """
    kept = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return kept.unionByName(df.filter(F.col(key).isNull()))
