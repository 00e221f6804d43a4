"""Cell joins (J1, J2, J4) and what keeps them even at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cellzonal.functions.grid import (
    ancestor,
    finest_hex_column,
    hex_columns,
    level_of,
    pack_sql,
    x_sql,
    y_sql,
)
from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.polyfill import BROADCAST_CELLS, blocks_from
from cellzonal.session import unsized


def broadcast_level(level: int, grid: Grid = NATIVE) -> int:
    """Finest level up to ``level`` at which any cell set may be broadcast."""
    while level > 0 and grid.cell_count(level) > BROADCAST_CELLS:
        level -= 1
    return level


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not in {df.columns}")


def is_compact(aoi: DataFrame) -> bool:
    """Whether an area is a ``compact_fill``, with cells of several levels."""
    return "cell" in aoi.columns


#: Runs are cut at the columns of this level, so that a row's runs meet near cells only.
RUN_BLOCK_LEVEL = 2


def is_runs(aoi: DataFrame) -> bool:
    """Whether an area is a ``run_area``, with runs of columns for rows of one level."""
    return {"x0", "x1"} <= set(aoi.columns)


def _run_row(aoi: DataFrame, level: int, grid: Grid) -> str:
    """The row column of an area of runs, which are of the native grid and one level."""
    if grid is not NATIVE:
        raise ValueError("runs are of the native grid")
    require_columns(aoi, f"r{level}")
    return f"r{level}"


def meet(
    cells: DataFrame,
    aoi: DataFrame,
    level: int,
    columns: Sequence[str],
    grid: Grid = NATIVE,
    how: str = "inner",
    on: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``h{level}`` with the given columns of an area of any kind, once per zone.

    Columns ``on`` of both sides, as a zone's id, must be equal as well.

    Plain areas are met by cell, compact ones by ancestors. Runs are met as intervals: rows
    and blocks of columns are equal, and the cell lies between a run's ends; no cell of
    the area and no ancestor of a row is ever written out.
    """
    if not is_runs(aoi):
        rows, area, keys = area_keys(cells, aoi, level, grid)
        keys = [*keys, *on]
        return rows.join(unsized(area.select(*keys, *columns)), keys, how).drop("_key")
    row, cell = _run_row(aoi, level, grid), f"h{level}"
    side = 3 ** max(level - RUN_BLOCK_LEVEL, 0)
    block = F.expr(f"explode(sequence(x0 div {side}L, x1 div {side}L))")
    runs = aoi.select(
        F.col(row).alias("_r"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"),
        block.alias("_b"), *[F.col(f"`{c}`").alias(f"_on_{c}") for c in on], *columns,
    )
    placed = cells.withColumn("_row", F.expr(y_sql(cell))).withColumn("_x", F.expr(x_sql(cell)))
    placed = placed.withColumn("_block", F.expr(f"_x div {side}L"))
    within = F.col("_x").between(F.col("_x0"), F.col("_x1"))
    same = (F.col("_row") == F.col("_r")) & (F.col("_block") == F.col("_b"))
    for c in on:
        same &= F.col(f"`{c}`") == F.col(f"`_on_{c}`")
    met = placed.join(unsized(runs), same & within, how)
    return met.drop("_row", "_x", "_block", "_r", "_x0", "_x1", "_b", *[f"_on_{c}" for c in on])


def area_keys(
    cells: DataFrame, aoi: DataFrame, level: int, grid: Grid = NATIVE
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of ``h{level}`` rows with an area, and the join key.

    A compact area is met by each row's ancestors from the level on that may be broadcast, its
    coarser blocks being cut; at most one per zone is there.
    """
    if not is_compact(aoi):
        return cells, aoi, [f"h{level}"]
    coarsest = broadcast_level(level, grid)
    aoi, levels = blocks_from(aoi, coarsest), range(coarsest, level + 1)
    lines = F.array(*[grid.parent(f"h{level}", level, k) for k in levels])
    return (
        cells.withColumn("_key", F.explode(lines)),
        aoi.withColumnRenamed("cell", "_key"),
        ["_key"],
    )


def prune_to_cells(facts: DataFrame, aoi: DataFrame, level: int, grid: Grid = NATIVE) -> DataFrame:
    """Facts whose cell, or its ancestor at a broadcast level, is in the area.

    Drops rows far from the area before any shuffle of the facts. Exact when
    ``broadcast_level(level) == level``, else a cover of the area.
    """
    cell = f"h{level}"
    coarse = broadcast_level(level, grid)
    if is_runs(aoi):
        side = f"{3 ** (level - coarse)}L"
        row = _run_row(aoi, level, grid)
        wide = aoi.selectExpr(*[f"{c} div {side} as {n}" for c, n in ((row, "_y"), ("x0", "_a"), ("x1", "_b"))])
        aoi = wide.distinct().selectExpr("_y", "explode(sequence(_a, _b)) as _x")
        above = F.expr(pack_sql(coarse, "_x", "_y"))
    elif is_compact(aoi):
        aoi, above = blocks_from(aoi, coarse), ancestor("cell", coarse)
    else:
        above = grid.parent(cell, level, coarse)
    cover = aoi.select(above.alias("_cover")).distinct()
    key = grid.parent(cell, level, coarse)
    return (
        facts.withColumn("_cover", key)
        .join(F.broadcast(cover), "_cover", "left_semi")
        .drop("_cover")
    )


def join_few(many: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join whose plan run-time sizes decide.

    Spark broadcasts ``few`` where its measured size is small; else it splits what a hot
    key of ``many`` has shuffled by its map tasks, so copies of one row spread as well.
    """
    return many.join(unsized(few), list(keys))


def no_clash(left: DataFrame, right: DataFrame, shared: Sequence[str]) -> None:
    """Raise where both sides have a column that neither is joined on nor a cell."""
    both = set(left.columns) & set(right.columns) - set(shared)
    clash = sorted(both - set(hex_columns(left.columns)))
    if clash:
        raise ValueError(f"both sides have the columns {clash}; rename them in one")


def cell_join(facts: DataFrame, aoi: DataFrame, level: int, grid: Grid = NATIVE) -> DataFrame:
    """Facts within an area: equi-join on ``h{level}``, once per zone.

    A column of both sides that is no cell, as an ``id`` of the facts, is an error.
    """
    cell = f"h{level}"
    require_columns(facts, cell)
    if is_runs(aoi):
        ids = [c for c in aoi.columns if c not in (f"r{level}", "x0", "x1")]
        no_clash(facts, aoi.select(*ids), [])
        return meet(prune_to_cells(facts, aoi, level, grid), aoi, level, ids, grid)
    require_columns(aoi, cell)
    no_clash(facts, aoi, [cell])
    zones = aoi.drop(*[c for c in aoi.columns if c != cell and c in facts.columns])
    return join_few(prune_to_cells(facts, aoi, level, grid), zones, [cell])


def align(data: DataFrame, aoi: DataFrame, grid: Grid = NATIVE) -> tuple[DataFrame, DataFrame, int, int]:
    """Bring both sides to a shared cell column.

    Returns ``(data, aoi, area level, join level)``: data at the area's level
    when it has that column or can be rolled up to it, else the area is
    coarsened to the data's finest level and keeps its own cell column.
    """
    area_level = level_of(finest_hex_column(aoi.columns))
    data_cells = hex_columns(data.columns)
    finest = level_of(finest_hex_column(data.columns))
    cell = f"h{area_level}"
    if cell in data_cells:
        return data, aoi, area_level, area_level
    if area_level < finest:
        rolled = data.withColumn(cell, grid.parent(f"h{finest}", finest, area_level))
        return rolled, aoi, area_level, area_level
    coarsened = aoi.withColumn(f"h{finest}", grid.parent(cell, area_level, finest))
    return data, coarsened, area_level, finest


def hex_join(data: DataFrame, aoi: DataFrame, grid: Grid = NATIVE) -> DataFrame:
    """Rows of ``data`` per area cell ``h3id``, at the area's resolution."""
    data, aoi, area_level, join_level = align(data, aoi, grid)
    key, cell = f"h{join_level}", f"h{area_level}"
    ids = [c for c in aoi.columns if c not in hex_columns(aoi.columns)]
    no_clash(data, aoi, [key])
    few = aoi.select(F.col(cell).alias("h3id"), F.col(key), *ids)
    joined = join_few(prune_to_cells(data, aoi, join_level, grid), few, [key])
    kept = [c for c in data.columns if c != cell and c not in ids]
    return joined.select("h3id", *ids, *kept)


def attach_geometry(
    stats: DataFrame,
    zones: DataFrame,
    id_column: str = "id",
    geometry: str = "geometry",
    keep_empty: bool = False,
) -> DataFrame:
    """Statistics with their zone's shape as ``geom``.

    Zones without data vanish; ``keep_empty`` keeps them with nulls.
    """
    require_columns(zones, id_column, geometry)
    shapes = zones.select(id_column, F.col(geometry).alias("geom"))
    joined = shapes.join(stats, id_column, "left" if keep_empty else "inner")
    return joined.select(*stats.columns, "geom")
