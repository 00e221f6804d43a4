"""Richness from range maps, whose cells may be coarser than the area's."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.joins import (
    align,
    attach_geometry,
    hex_join,
    join_few,
    prune_to_cells,
    require_columns,
)
from cellzonal.operators.stats import log_normalise
from cellzonal.operators.taxa import Selection, filter_by_taxonomy


def open_area(
    ranges: DataFrame,
    aoi: DataFrame,
    taxonomy: DataFrame | None = None,
    taxa: Selection | None = None,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Range rows of the chosen taxa per area cell ``h3id``.

    The taxon filter goes first: it is the smaller side.
    """
    return hex_join(_chosen(ranges, taxonomy, taxa), aoi, grid)


def detail_table(
    ranges: DataFrame,
    aoi: DataFrame,
    taxonomy: DataFrame | None = None,
    taxa: Selection | None = None,
    rows: int | None = None,
    grid: Grid = NATIVE,
) -> DataFrame:
    """The joined rows themselves; ``rows`` gives a preview."""
    detail = open_area(ranges, aoi, taxonomy, taxa, grid)
    return detail if rows is None else detail.limit(rows)


def range_hex_richness(
    ranges: DataFrame,
    aoi: DataFrame,
    taxonomy: DataFrame | None = None,
    taxa: Selection | None = None,
    distinct: bool = False,
    taxon: str = "taxon_id",
    geometry: bool = True,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Range rows per area cell: ``h3id, n, logn, value[, geom]``.

    ``distinct`` counts taxa instead of rows. A cell lying in several zones
    counts once per zone, unless ``distinct`` is set.
    """
    data, area, level, join_level = align(_chosen(ranges, taxonomy, taxa), aoi, grid)
    cell, key = f"h{level}", f"h{join_level}"
    zones_per_cell = area.groupBy(*dict.fromkeys([cell, key])).agg(
        F.count(F.lit(1)).alias("_zones")
    )
    per_key = _rows_per_key(data, area, join_level, distinct, taxon, grid)
    times = F.lit(1) if distinct else F.col("_zones")
    counts = per_key.join(zones_per_cell, key).select(
        F.col(cell).alias("h3id"), (F.col("n") * times).alias("n")
    )
    result = log_normalise(counts)
    return grid.with_boundary(result, "h3id", level, "geom") if geometry else result


def range_zonal_richness(
    ranges: DataFrame,
    aoi: DataFrame,
    id_column: str = "id",
    taxonomy: DataFrame | None = None,
    taxa: Selection | None = None,
    distinct: bool = False,
    taxon: str = "taxon_id",
    zones: DataFrame | None = None,
    keep_empty: bool = False,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Range rows per zone: ``id, n, logn, value[, geom]``.

    A coarse range cell counts once per area cell within it; ``distinct``
    counts taxa of the zone instead.
    """
    require_columns(aoi, id_column)
    data, area, level, join_level = align(_chosen(ranges, taxonomy, taxa), aoi, grid)
    key = f"h{join_level}"
    if distinct:
        near = prune_to_cells(data.select(taxon, key), area, join_level, grid).distinct()
        counts = (
            join_few(near, area.select(key, id_column).distinct(), [key])
            .select(taxon, id_column)
            .distinct()
            .groupBy(id_column)
            .agg(F.count(F.lit(1)).alias("n"))
        )
    else:
        per_key = _rows_per_key(data, area, join_level, False, taxon, grid)
        cells = area.groupBy(key, id_column).agg(F.count(F.lit(1)).alias("_cells"))
        counts = (
            per_key.join(cells, key)
            .groupBy(id_column)
            .agg(F.sum(F.col("n") * F.col("_cells")).alias("n"))
        )
    result = log_normalise(counts)
    if zones is None:
        return result
    return attach_geometry(result, zones, id_column, keep_empty=keep_empty)


def _chosen(ranges: DataFrame, taxonomy: DataFrame | None, taxa: Selection | None) -> DataFrame:
    if not taxa:
        return ranges
    if taxonomy is None:
        raise ValueError("a taxon selection needs the taxonomy table")
    return filter_by_taxonomy(ranges, taxonomy, taxa)


def _rows_per_key(
    data: DataFrame, area: DataFrame, level: int, distinct: bool, taxon: str, grid: Grid
) -> DataFrame:
    """Rows (or taxa) per join cell, counted before the join."""
    key = f"h{level}"
    near = prune_to_cells(data.select(taxon, key), area, level, grid)
    if distinct:
        near = near.distinct()
    return near.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
