"""Mean of a measured value per cell and per zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.joins import (
    attach_geometry,
    broadcast_level,
    is_compact,
    meet,
    prune_to_cells,
    require_columns,
)
from cellzonal.operators.stats import linear_normalise


def sums_per_cell(
    facts: DataFrame, aoi: DataFrame, level: int, value: str, grid: Grid
) -> DataFrame:
    """Sum and count of the value per cell near the area, before any join."""
    cell = f"h{level}"
    require_columns(facts, cell, value)
    near = prune_to_cells(facts.select(cell, value), aoi, level, grid)
    return near.groupBy(cell).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count")
    )


def hex_carbon(
    facts: DataFrame,
    aoi: DataFrame,
    level: int,
    value: str = "carbon",
    geometry: bool = True,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Mean per cell of the area: ``h3id, carbon, value[, geom]`` (A10)."""
    cell = f"h{level}"
    per_cell = sums_per_cell(facts, aoi, level, value, grid)
    if broadcast_level(level, grid) < level:
        per_cell = meet(per_cell, aoi, level, [], grid, "left_semi")
        if is_compact(aoi):
            # Zones may hold the same cell in blocks of different levels.
            per_cell = per_cell.dropDuplicates([cell])
    means = per_cell.select(
        F.col(cell).alias("h3id"), F.try_divide("_sum", "_count").alias(value)
    )
    result = linear_normalise(means, value)
    return grid.with_boundary(result, "h3id", level, "geom") if geometry else result


def zonal_carbon(
    facts: DataFrame,
    aoi: DataFrame,
    level: int,
    id_column: str = "id",
    value: str = "carbon",
    zones: DataFrame | None = None,
    keep_empty: bool = False,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Unweighted mean of all rows in a zone: ``id, carbon, value[, geom]``."""
    require_columns(aoi, id_column)
    per_cell = sums_per_cell(facts, aoi, level, value, grid)
    means = (
        meet(per_cell, aoi, level, [id_column], grid)
        .groupBy(id_column)
        .agg(F.try_divide(F.sum("_sum"), F.sum("_count")).alias(value))
    )
    result = linear_normalise(means, value)
    if zones is None:
        return result
    return attach_geometry(result, zones, id_column, keep_empty=keep_empty)
