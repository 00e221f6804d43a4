"""Result sinks: Parquet, GeoJSON features, CSV (K1, K4, K9)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from cellzonal.functions import geometry as geo


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet folder (K1)."""
    df.write.mode(mode).parquet(path)


def geometry_json(geometry: Column) -> Column:
    """GeoJSON geometry struct of a parts-and-rings geometry."""
    return F.struct(
        F.lit("MultiPolygon").alias("type"), geo.coordinates(geometry).alias("coordinates")
    )


def to_features(
    df: DataFrame, geometry: str = "geom", properties: Sequence[str] | None = None
) -> DataFrame:
    """One GeoJSON Feature text per row, in column ``value`` (K4)."""
    names = [c for c in df.columns if c != geometry] if properties is None else properties
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geometry_json(F.col(geometry)).alias("geometry"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(
    df: DataFrame, path: str, geometry: str = "geom", mode: str = "errorifexists"
) -> None:
    """Newline-delimited GeoJSON features, written by all tasks at once (K4)."""
    to_features(df, geometry).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Downloadable table with a header line (K9)."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_geojson_document(
    df: DataFrame, path: str, geometry: str = "geom", properties: Sequence[str] | None = None
) -> None:
    """One FeatureCollection in one file, written by all tasks (K4).

    Rows keep their order, so a sorted table gives a sorted document. See ``_join_files``
    for where it can be written; an existing file is an error.
    """
    spark = df.sparkSession
    parts = _open_target(spark, path)
    # The first row of a task has no comma; between two tasks' files comes a file with one.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    lines = to_features(df, geometry, properties).select(
        F.concat(F.when(first, "").otherwise(","), "value").alias("value")
    )
    lines.write.option("maxRecordsPerFile", 0).text(f"{parts}/rows")
    for name, text in (("head", '{"type":"FeatureCollection","features":['), ("tail", "]}")):
        spark.range(1).select(F.lit(text)).coalesce(1).write.text(f"{parts}/{name}")
    _join_files(spark, parts, path, ",\n")


def write_csv_document(df: DataFrame, path: str) -> None:
    """One CSV file with one header line, written by all tasks, rows in their order (K9)."""
    spark = df.sparkSession
    parts = _open_target(spark, path)
    df.write.option("maxRecordsPerFile", 0).csv(f"{parts}/rows")
    names = spark.range(1).select(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    names.coalesce(1).write.csv(f"{parts}/head")
    _join_files(spark, parts, path, "")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path of a place."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    return files, files.makeQualified(place)


def _open_target(spark: SparkSession, path: str) -> str:
    """A new folder beside a file to be, for its parts."""
    files, place = _files(spark, path)
    if files.exists(place):
        raise FileExistsError(path)
    if place.toUri().getScheme() != "file" and not files.hasPathCapability(place, "fs.capability.paths.concat"):
        raise ValueError(f"{place.toUri().getScheme()} cannot join files: write parts instead")
    return f"{place.getParent()}/.{place.getName()}-{uuid.uuid4().hex}"


def _join_files(spark: SparkSession, parts: str, path: str, between: str) -> None:
    """Head, rows in order of their tasks, and tail as one file; none passes the driver.

    A file system that joins files (HDFS) does so by itself, in order of names. On mounted
    folders that all executors share, every task copies parts to their places in one file,
    which is renamed when all are there: copying again after a lost executor changes nothing.
    Other stores are refused before any work.
    """
    files, place = _files(spark, path)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in ("head", "rows", "tail"):
        folder = Path(f"{parts}/{name}")
        given = files.listStatus(folder) if files.exists(folder) else []
        sized = sorted((f.getPath().toString(), f.getLen()) for f in given if f.getLen() and f.getPath().getName().startswith("part-"))
        for n, (part, length) in enumerate(sized):
            if n and between and name == "rows":
                found.append((None, len(between)))
            found.append((part, length))
    if place.toUri().getScheme() == "file":
        _copy_to_places(spark, found, _local(f"{parts}/whole"), between)
        whole = Path(f"{parts}/whole")
    else:
        whole, *rest = [Path(part) if part else _small_file(files, Path(f"{parts}/{n}"), between) for n, (part, _) in enumerate(found)]
        gateway = spark.sparkContext._gateway
        array = gateway.new_array(Path, len(rest))
        for n, part in enumerate(rest):
            array[n] = part
        files.concat(whole, array)
    if not files.rename(whole, place):
        raise OSError(f"could not name {place}")
    files.delete(Path(parts), True)


def _small_file(files, place, text: str):
    stream = files.create(place)
    stream.write(text.encode())
    stream.close()
    return place


def _local(uri: str) -> str:
    return unquote(urlparse(uri).path)


def _copy_to_places(spark: SparkSession, found: Sequence[tuple], whole: str, between: str) -> None:
    """Parts copied to their offsets in one new file, some per task."""
    plan, at = [], 0
    for part, length in found:
        plan.append((_local(part) if part else None, at, length))
        at += length
    with open(whole, "wb") as out:
        out.truncate(at)

    def copy(places: Iterable[Row]) -> None:
        # Without O_CREAT, so that a folder which is not shared is an error.
        target = os.open(whole, os.O_WRONLY)
        try:
            for row in places:
                if row.part is None:
                    os.pwrite(target, between.encode(), row.at)
                    continue
                with open(row.part, "rb") as source:
                    done = 0
                    while block := source.read(1 << 20):
                        view = memoryview(block)
                        while view:
                            n = os.pwrite(target, view, row.at + done)
                            view, done = view[n:], done + n
                if done != row.length:
                    raise OSError(f"{row.part} has {done} bytes, not {row.length}")
            os.fsync(target)
        finally:
            os.close(target)

    if plan:
        rows = spark.createDataFrame(plan, "part string, at long, length long")
        rows.repartition(min(len(plan), spark.sparkContext.defaultParallelism)).foreachPartition(copy)


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """First rows for display (K8, O2)."""
    return df.limit(rows)
