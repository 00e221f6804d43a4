"""Jobs that build the cell-partitioned inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.layers import admin_level
from cellzonal.sources.tables import bucketed_name


def clean_values(
    raw: DataFrame, value: str = "Z", cell: str = "h_zoom", level: int = 8, name: str = "carbon"
) -> DataFrame:
    """Rows with a value, under their final names (B1)."""
    kept = [c for c in raw.columns if c == "h0"]
    return raw.where(F.col(value).isNotNull()).select(
        *kept, F.col(value).alias(name), F.col(cell).alias(f"h{level}")
    )


def with_parents(
    df: DataFrame, level: int, to_levels: Sequence[int], grid: Grid = NATIVE
) -> DataFrame:
    """Coarser cell columns from the finest one."""
    cell = f"h{level}"
    return df.withColumns({f"h{k}": grid.parent(cell, level, k) for k in to_levels})


def write_by_base_cell(df: DataFrame, path: str, column: str = "h0", mode: str = "errorifexists") -> None:
    """Partitioned write without a shuffle: each task adds a file per base cell (K2)."""
    df.write.mode(mode).partitionBy(column).parquet(path)


def write_compact(
    df: DataFrame,
    path: str,
    column: str = "h0",
    rows_per_file: int | None = 10_000_000,
    mode: str = "errorifexists",
) -> None:
    """Few files per base cell: one for small cells, more for crowded ones (K3).

    Rows are rebalanced by base cell; a base cell too large for one task is
    split by Spark at run time, so a crowded one never waits for a single writer.
    ``rows_per_file=None`` sends each base cell to one task for exactly one file.
    """
    if rows_per_file is None:
        spread, writer_rows = df.repartition(column), 0
    else:
        spread, writer_rows = df.hint("rebalance", F.col(column)), rows_per_file
    spread.write.mode(mode).option("maxRecordsPerFile", writer_rows).partitionBy(column).parquet(path)


def write_bucketed(
    df: DataFrame, path: str, column: str, buckets: int, mode: str = "errorifexists"
) -> None:
    """Rows dealt out by cell into sorted buckets, one file each (K3).

    ``sources.tables.open_bucketed`` reads them back with no shuffle for what groups or joins
    by that cell, so the shuffle here is the last one of these rows. A cell is in one
    bucket: write distinct or summed rows where one cell may hold most records.
    """
    name = bucketed_name(path)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, column).write.mode(mode).format("parquet")
    dealt.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)


def admin_layer(divisions: DataFrame, subtype: str) -> DataFrame:
    """Land areas of one level with their main name as ``primary``."""
    return admin_level(divisions, subtype).withColumn("primary", F.col("names.primary"))


def tract_layer(tracts: DataFrame) -> DataFrame:
    """Census tracts under the common column names."""
    return tracts.withColumnRenamed("Shape", "geometry").withColumn("id", F.col("FIPS"))


def quality_report(df: DataFrame, column: str) -> DataFrame:
    """Rows in all, and rows with and without a value."""
    value = F.col(column)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value.isNull()).alias("missing"),
        F.count(value).alias("present"),
    )
    checks = counts.unpivot([], ["rows", "missing", "present"], "check", "n")
    return checks.where("`check` = 'rows' or n > 0")
