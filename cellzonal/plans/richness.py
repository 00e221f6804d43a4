"""Species richness from occurrence records keyed by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.joins import (
    attach_geometry,
    is_compact,
    is_runs,
    meet,
    prune_to_cells,
    require_columns,
)
from cellzonal.operators.stats import log_normalise
from cellzonal.operators.taxa import RANKS, Selection, filter_taxa

MODES = ("occupancy", "species")


def taxa_per_cell(seen: DataFrame, cell: str) -> DataFrame:
    """Distinct rows of ``(taxon, cell)`` to a count per cell."""
    return seen.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))


def zones_per_area_cell(aoi: DataFrame, cell: str) -> DataFrame:
    """How many zones hold each cell of an area; a run counts for itself."""
    if is_runs(aoi):
        return aoi.withColumn("_zones", F.lit(1))
    key = "cell" if is_compact(aoi) else cell
    return aoi.groupBy(key).agg(F.count(F.lit(1)).alias("_zones"))


def distinct_sightings(
    occurrences: DataFrame,
    aoi: DataFrame,
    level: int,
    taxa: Selection | None,
    columns: tuple[str, ...],
    grid: Grid,
) -> DataFrame:
    """Distinct ``(columns, cell)`` near the area.

    Duplicates go before any join, so a cell or taxon holding most of the
    records shrinks to one row per pair already on the map side.
    """
    cell = f"h{level}"
    require_columns(occurrences, cell, *columns)
    chosen = filter_taxa(occurrences, taxa).select(*[F.col(f"`{c}`") for c in columns], cell)
    return prune_to_cells(chosen, aoi, level, grid).distinct()


def hex_richness(
    occurrences: DataFrame,
    aoi: DataFrame,
    level: int,
    taxa: Selection | None = None,
    taxon: str = "taxonkey",
    geometry: bool = True,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Taxa per cell of the area: ``h3id, n, logn, value[, geom]``.

    A cell lying in several zones counts its taxa once per zone.
    """
    cell = f"h{level}"
    seen = distinct_sightings(occurrences, aoi, level, taxa, (taxon,), grid)
    per_cell = meet(
        taxa_per_cell(seen, cell), zones_per_area_cell(aoi, cell), level, ["_zones"], grid
    )
    counts = per_cell.select(F.col(cell).alias("h3id"), (F.col("n") * F.col("_zones")).alias("n"))
    if is_compact(aoi) or is_runs(aoi):
        counts = counts.groupBy("h3id").agg(F.sum("n").alias("n"))
    result = log_normalise(counts)
    return grid.with_boundary(result, "h3id", level, "geom") if geometry else result


def zonal_richness(
    occurrences: DataFrame,
    aoi: DataFrame,
    level: int,
    id_column: str = "id",
    taxa: Selection | None = None,
    mode: str = "occupancy",
    taxon: str = "taxonkey",
    zones: DataFrame | None = None,
    keep_empty: bool = False,
    grid: Grid = NATIVE,
) -> DataFrame:
    """Richness per zone: ``id, n, logn, value[, geom]``.

    ``occupancy`` counts distinct (taxon, cell) pairs of a zone, ``species``
    its distinct taxa. Shapes are joined on when ``zones`` is given.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    require_columns(aoi, id_column)
    cell = f"h{level}"
    seen = distinct_sightings(occurrences, aoi, level, taxa, (taxon,), grid)
    rows = taxa_per_cell(seen, cell) if mode == "occupancy" else seen
    met = meet(rows, aoi.drop("h0") if level else aoi, level, [id_column], grid)
    if mode == "occupancy":
        counts = met.groupBy(id_column).agg(F.sum("n").alias("n"))
    else:
        counts = (
            met.select(taxon, id_column)
            .distinct()
            .groupBy(id_column)
            .agg(F.count(F.lit(1)).alias("n"))
        )
    result = log_normalise(counts)
    if zones is None:
        return result
    return attach_geometry(result, zones, id_column, keep_empty=keep_empty)


def species_table(
    occurrences: DataFrame,
    aoi: DataFrame,
    level: int,
    taxa: Selection | None = None,
    taxon: str = "taxonkey",
    grid: Grid = NATIVE,
) -> DataFrame:
    """Cells occupied per species: ranks, taxon, ``n``.

    A cell lying in several zones counts once per zone.
    """
    cell = f"h{level}"
    seen = distinct_sightings(occurrences, aoi, level, taxa, (*RANKS, taxon), grid)
    met = meet(seen, zones_per_area_cell(aoi, cell), level, ["_zones"], grid)
    ranks = [F.col(f"`{r}`") for r in RANKS]
    return met.groupBy(*ranks, taxon).agg(F.sum("_zones").cast("long").alias("n"))
