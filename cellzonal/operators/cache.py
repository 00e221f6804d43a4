"""Results stored under a digest of what they depend on (K1, K5, K6, K7)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.publish import write_geojson
from cellzonal.session import shared_folder

# Raise when a stored result would come out differently.
VERSION = 2


def _value_text(value: Column, kind: str) -> Column:
    if kind == "binary":
        return F.hex(value)
    if kind.startswith(("struct", "array", "map")):
        nested = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        return F.when(value.isNotNull(), nested)
    return value.cast("string")


def fingerprint_columns(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row ``n, digest`` that depends on the rows but not on their order (K7).

    Sums of two 60-bit slices of each row's MD5, so copies of a row count and do not
    cancel out. A row's text gives every value behind its length, and null as ``-``.
    With ``by``, one such row for each value of these columns.
    """
    values = [_value_text(F.col(f"`{c}`"), kind) for c, kind in df.dtypes]
    sized = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in values]
    text = F.concat(F.lit(""), *[F.coalesce(v, F.lit("-")) for v in sized])
    digest = df.select(*by, F.md5(text.cast("binary")).alias("d"))
    hashed = digest.select(
        *by,
        F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)").alias("a"),
        F.conv(F.substring("d", 16, 15), 16, 10).cast("decimal(38,0)").alias("b"),
    )
    sums = hashed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("b"),
    )
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("digest"))


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's content and column names."""
    content = fingerprint_columns(df).first()["digest"]
    return hashlib.sha256(json.dumps([df.dtypes, content]).encode()).hexdigest()


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a folder's file names, sizes and times; reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return fingerprint(files.select("path", "length", "modificationTime"))


def cache_key(label: str, inputs: Sequence[str], params: Mapping[str, object]) -> str:
    """Name of a result: every input's digest and every parameter count."""
    text = json.dumps([VERSION, label, list(inputs), params], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _complete_runs(spark: SparkSession, path: str) -> list[str]:
    """Finished writes below a cache entry, in name order."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/run-*/_SUCCESS")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(pattern)
    return sorted(str(s.getPath().getParent()) for s in found or [])


def is_cached(spark: SparkSession, path: str) -> bool:
    """Whether an entry holds a finished result (K5)."""
    return bool(_complete_runs(spark, path))


def stored_folder(
    spark: SparkSession,
    label: str,
    inputs: Sequence[str],
    params: Mapping[str, object],
    write: Callable[[str], None],
    root: str | None = None,
) -> str:
    """Folder of a finished result, written first when absent (K6).

    Every writer uses a folder of its own and readers look for its success mark,
    so a lost job or two jobs at once never leave a half-written result in view.
    """
    path = f"{root or shared_folder(spark) + '/results'}/{label}/{cache_key(label, inputs, params)}"
    runs = _complete_runs(spark, path)
    if not runs:
        write(f"{path}/run-{uuid.uuid4().hex}")
        runs = _complete_runs(spark, path)
    return runs[0]


def cached(
    spark: SparkSession,
    label: str,
    inputs: Sequence[str],
    params: Mapping[str, object],
    compute: Callable[[], DataFrame],
    root: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The stored result as a table, computed only when absent (K6)."""

    def write(path: str) -> None:
        compute().write.partitionBy(*partition_by).parquet(path)

    return spark.read.parquet(stored_folder(spark, label, inputs, params, write, root))


def _stored_parts(spark: SparkSession, path: str, column: str) -> dict[tuple[str, str], str]:
    """Folders of finished runs by the text of their base cell and their digest."""
    jvm = spark.sparkContext._jvm

    def listed(pattern: str) -> list[str]:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(str(s.getPath()) for s in files.globStatus(at) or [])

    finished = {p.rsplit("/", 1)[0] for p in listed(f"{path}/_run=*/_SUCCESS")}
    found: dict[tuple[str, str], str] = {}
    for part in listed(f"{path}/_run=*/{column}=*/_digest=*"):
        run, cell, digest = part.rsplit("/", 2)
        if run in finished:
            found.setdefault((cell.split("=", 1)[1], digest.split("=", 1)[1]), part)
    return found


def cached_by_part(
    facts: DataFrame,
    label: str,
    params: Mapping[str, object],
    compute: Callable[[DataFrame], DataFrame],
    root: str | None = None,
    column: str = "h0",
) -> DataFrame:
    """A stored result of which only changed base cells are computed again (K6).

    ``compute`` takes the facts of some base cells and gives rows with ``column`` that depend
    on facts of their own base cell only; normalise afterwards. A digest per base cell
    tells what changed; there are at most as many as the grid has base cells. New
    parts go to a folder of their own and older ones stay as they are, so a lost job changes
    nothing that is read. Facts without base cell are left out, and a base cell
    without result rows is computed at each call.
    """
    spark = facts.sparkSession
    facts = facts.dropna(subset=[column])
    path = f"{root or shared_folder(spark) + '/results'}/{label}/{cache_key(label, [], {**params, 'by': column})}"
    shape = compute(facts).schema
    clash = sorted({"_run", "_digest"} & set(shape.names))
    if clash or column not in shape.names:
        raise ValueError(f"the result must have {column} and neither of _run and _digest: {shape.names}")
    content = hashlib.sha256(json.dumps(facts.dtypes).encode()).hexdigest()[:16]
    digests = fingerprint_columns(facts, [column]).select(column, F.concat(F.lit(content), "digest").alias("_digest"))
    wanted = {(str(row[0]), row[1]): row for row in digests.collect()}
    found = _stored_parts(spark, path, column)
    stale = [row for key, row in wanted.items() if key not in found]
    if stale:
        known = spark.createDataFrame(stale, digests.schema)
        rows = compute(facts.where(F.col(column).isin([row[0] for row in stale])))
        rows.join(F.broadcast(known), column).write.partitionBy(column, "_digest").parquet(
            f"{path}/_run={uuid.uuid4().hex}"
        )
        found = _stored_parts(spark, path, column)
    parts = [found[key] for key in sorted(wanted) if key in found]
    if not parts:
        return spark.createDataFrame([], shape)
    whole = spark.read.schema(shape).option("basePath", path).parquet(*parts)
    return whole.select(*[F.col(f"`{c}`") for c in shape.names])


def published(
    spark: SparkSession,
    label: str,
    inputs: Sequence[str],
    params: Mapping[str, object],
    compute: Callable[[], DataFrame],
    root: str | None = None,
    geometry: str = "geom",
) -> str:
    """Folder of the result as GeoJSON features, computed only when absent (K4, K6)."""

    def write(path: str) -> None:
        write_geojson(compute(), path, geometry)

    return stored_folder(spark, label, inputs, params, write, root)


def grid_key(grid: Grid) -> str:
    """What a grid's cells depend on; for a dictionary its content."""
    dictionary = getattr(grid, "dictionary", None)
    if dictionary is None:
        return repr(grid)
    return f"{type(grid).__name__} {grid.bucket_level} {fingerprint(dictionary)}"


def cached_aoi(
    zones: DataFrame,
    level: int,
    keep: Sequence[str] = ("id",),
    grid: Grid = NATIVE,
    root: str | None = None,
) -> DataFrame:
    """Area cells computed once per (zones, level, kept columns) and then reread."""
    params = {"level": level, "keep": list(keep), "grid": grid_key(grid)}
    return cached(
        zones.sparkSession,
        "aoi",
        [fingerprint(zones)],
        params,
        lambda: grid.polyfill(zones, level, keep),
        root,
    )
