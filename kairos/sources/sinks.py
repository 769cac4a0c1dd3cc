"""Sinks: Parquet tables partitioned for pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_within: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write Parquet; sorting within partitions by time keeps row-group min/max
    tight so later time-window filters skip row groups."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_year_files(df: DataFrame, path: str, time_col: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year and sorted by time, with a column ``year``.

    Rows are dealt out by (year, hash of the day), so a heavy year is several files of ordered days and no
    task holds it whole."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(F.col(time_col).cast("date")), F.lit(max(1, parts // 4)))
    dealt = df.withColumn("year", F.year(time_col)).repartition("year", spread)
    write_table(dealt, path, ["year"], ["year", time_col], mode)


def read_years(spark: SparkSession, path: str, years: DataFrame) -> DataFrame:
    """The rows of year files for the years of a small table (one row per year), with its columns.

    The table is broadcast: years are few by nature.  Its rows become a filter on the partitions at run time,
    so files of other years are not opened."""
    return spark.read.parquet(path).join(F.broadcast(years), "year")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export for tools that need it; Parquet is the default landing format."""
    df.write.mode(mode).option("header", True).csv(path)


def save_model_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Persist a fitted model as its coef / ranef / fit tables."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def load_model_tables(spark: SparkSession, root: str, names: Sequence[str] = ("coef", "ranef", "fit")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}
