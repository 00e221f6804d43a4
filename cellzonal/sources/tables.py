"""Table scans: Parquet, cell-partitioned Parquet, object stores."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def open_table(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """Lazy Parquet table; several paths or a glob are read as one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def open_files(
    spark: SparkSession, paths: Sequence[str], root: str, schema: StructType | str | None = None
) -> DataFrame:
    """Chosen files of a partitioned table, partition columns included."""
    reader = spark.read.option("basePath", root)
    return (reader if schema is None else reader.schema(schema)).parquet(*paths)


def open_cells(
    spark: SparkSession, root: str, schema: StructType | str | None = None, column: str = "h0"
) -> DataFrame:
    """All partitions of a table partitioned by base cell.

    Without a schema the base cell keeps its own spelling as text, or BIGINT
    when every value is a number.
    """
    df = open_table(spark, root, schema)
    if dict(df.dtypes)[column] == "int":
        return df.withColumn(column, F.col(column).cast("long"))
    return df


def open_partitions(df: DataFrame, values: Iterable[object], column: str = "h0") -> DataFrame:
    """Only the named partitions; none named means all (S3)."""
    wanted = list(values)
    return df.where(F.col(column).isin(wanted)) if wanted else df


def base_cells(aoi: DataFrame, column: str = "h0") -> list[object]:
    """Base cells an area touches: at most one value per base cell of the grid."""
    return [row[0] for row in aoi.select(column).distinct().collect()]


def open_region(df: DataFrame, aoi: DataFrame, column: str = "h0") -> DataFrame:
    """Partitions an area touches, as a filter on the partition column.

    The list is read first, so the scan prunes folders when it is planned.
    Ids may be numbers or hex text of either case, on either side.
    """
    ids = [int(c, 16) if isinstance(c, str) else c for c in base_cells(aoi) if c is not None]
    if dict(df.dtypes)[column] == "string":
        spellings = [s for i in ids for s in sorted({f"{i:x}", f"{i:X}"})]
        return df.where(F.col(column).isin(spellings))
    return df.where(F.col(column).isin(ids))


def bucketed_name(path: str) -> str:
    """The catalog's name for a bucketed table, which its folder determines."""
    return f"cells_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def open_bucketed(spark: SparkSession, path: str, column: str, buckets: int) -> DataFrame:
    """A table of ``prepare.write_bucketed``, of this session or another one."""
    name = bucketed_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{column}`) "
            f"SORTED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes


def any_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns that exist, in the order asked for."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


# -- object stores ---------------------------------------------------------------


def bucket_conf(
    bucket: str, endpoint: str, key: str = "", secret: str = "", use_ssl: bool = True
) -> dict[str, str]:
    """Hadoop settings for one bucket; without a key it is read anonymously."""
    prefix = f"spark.hadoop.fs.s3a.bucket.{bucket}"
    conf = {
        f"{prefix}.endpoint": endpoint,
        f"{prefix}.path.style.access": "true",
        f"{prefix}.connection.ssl.enabled": str(use_ssl).lower(),
    }
    if key:
        return conf | {f"{prefix}.access.key": key, f"{prefix}.secret.key": secret}
    provider = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return conf | {f"{prefix}.aws.credentials.provider": provider}


def protocol(use_https: str | bool | None) -> str:
    """``http`` when https is switched off, else ``https``."""
    off = str(use_https).strip().lower() in ("false", "f")
    return "http" if off else "https"


def public_url(path: str, server: str, use_https: str | bool | None = None) -> str:
    """Web address of an object: ``s3://bucket/key`` on a server."""
    return re.sub(r"^s3a?://", f"{protocol(use_https)}://{server}/", path)


def public_url_column(path: Column, server: str, use_https: str | bool | None = None) -> Column:
    return F.regexp_replace(path, r"^s3a?://", f"{protocol(use_https)}://{server}/")
