"""Parquet table scans (S5/S10 re-aimed at Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One Parquet table; selecting ``columns`` up front keeps the ReadSchema narrow.

    Catalyst would prune unused columns anyway; the explicit list documents
    intent and fails fast on a misspelt column.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
