"""Taxa of each cell as bitmaps that merge, so that coarser cells and zones need no facts.

Rows are ``cell, bucket, taxa, pairs``: one bitmap per cell and range of 32 768 taxon ids, and how
many different (taxon, finest cell) pairs it stands for. A union of bitmaps gives the taxa
of any union of cells, and pairs add up, so both kinds of zonal richness come from
stored sets. A bitmap takes 4 KB in memory and little more than its taxa when written or
shuffled, as those compress; keep sets from a level on whose cells hold many records.

``listed_sets`` has lists instead of bitmaps, of four bytes a taxon: rows ``cell, bucket, positions,
pairs`` of all levels at once, for taxa that are many or cells that are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from cellzonal.functions.grid import ancestor
from cellzonal.operators.grids import NATIVE, Grid
from cellzonal.operators.joins import is_compact, is_runs, require_columns
from cellzonal.operators.polyfill import blocks_from
from cellzonal.operators.stats import log_normalise
from cellzonal.plans.richness import MODES, zones_per_area_cell


def taxa_sets(occurrences: DataFrame, level: int, taxon: str = "taxonkey") -> DataFrame:
    """Sets of the cells ``h{level}`` of records. Taxa are whole numbers.

    Records without taxon count as one taxon, in a bucket that is null, as they do in the other
    statistics; those without cell are left out. Repeated records go before bitmaps are made.
    """
    bit = F.coalesce(F.bitmap_bit_position("_taxon"), F.lit(0).cast("long"))
    sets = _seen(occurrences, level, taxon).groupBy("cell", F.bitmap_bucket_number("_taxon").alias("bucket")).agg(
        F.bitmap_construct_agg(bit).alias("taxa")
    )
    return sets.withColumn("pairs", F.bitmap_count("taxa"))


def _seen(occurrences: DataFrame, level: int, taxon: str) -> DataFrame:
    """Distinct ``cell, _taxon`` of records that have a cell."""
    cell = f"h{level}"
    require_columns(occurrences, cell, taxon)
    if not isinstance(occurrences.schema[taxon].dataType, IntegralType):
        raise ValueError(f"{taxon} must be a whole number, not {occurrences.schema[taxon].dataType}")
    taxa = F.col(f"`{taxon}`").cast("long")
    return occurrences.select(F.col(cell).alias("cell"), taxa.alias("_taxon")).dropna(subset=["cell"]).distinct()


#: A list has the taxa of one range of ids this wide, so that none grows beyond 4 MB.
LIST_BITS = 20


def listed_sets(
    occurrences: DataFrame, level: int, coarsest: int, taxon: str = "taxonkey", grid: Grid = NATIVE
) -> DataFrame:
    """Sets of all levels ``coarsest .. level`` as ``cell, bucket, positions, pairs``.

    They hold what ``with_coarser(taxa_sets(...))`` holds. Distinct (taxon, finest cell) pairs
    are dealt out once, by coarsest cell and range of ids; each task then has all that its
    cells of every level need, so only pairs are shuffled.
    """
    top = grid.parent("cell", level, coarsest).alias("_top")
    bucket = F.shiftright("_taxon", LIST_BITS).alias("bucket")
    position = F.coalesce(F.col("_taxon").bitwiseAND(F.lit((1 << LIST_BITS) - 1)), F.lit(0)).cast("int")
    dealt = _seen(occurrences, level, taxon).select(top, "cell", bucket, position.alias("_position"))
    lines = F.array(*[grid.parent("cell", level, k) for k in range(coarsest, level + 1)])
    up = dealt.repartition("_top", "bucket").withColumn("cell", F.explode(lines))
    sets = up.groupBy("_top", "bucket", "cell").agg(
        F.sort_array(F.collect_set("_position")).alias("positions"), F.count(F.lit(1)).alias("pairs")
    )
    return sets.select("cell", "bucket", "positions", "pairs")


def merge(sets: DataFrame, more: DataFrame) -> DataFrame:
    """Sets of all records, from those of old and new ones, at the level they are made at."""
    both = sets.unionByName(more).groupBy("cell", "bucket").agg(F.bitmap_or_agg("taxa").alias("taxa"))
    return both.withColumn("pairs", F.bitmap_count("taxa"))


def roll_up(sets: DataFrame, level: int, to_level: int, grid: Grid = NATIVE) -> DataFrame:
    """Sets of a coarser level from those of one level."""
    up = sets.withColumn("cell", grid.parent("cell", level, to_level))
    return up.groupBy("cell", "bucket").agg(F.bitmap_or_agg("taxa").alias("taxa"), F.sum("pairs").alias("pairs"))


def with_coarser(sets: DataFrame, level: int, coarsest: int, grid: Grid = NATIVE) -> DataFrame:
    """Sets of one level and of all coarser ones down to ``coarsest``, which zones are met with."""
    lines = F.array(*[grid.parent("cell", level, k) for k in range(coarsest, level + 1)])
    up = sets.withColumn("cell", F.explode(lines))
    return up.groupBy("cell", "bucket").agg(F.bitmap_or_agg("taxa").alias("taxa"), F.sum("pairs").alias("pairs"))


def hex_richness(sets: DataFrame, aoi: DataFrame, level: int) -> DataFrame:
    """Taxa per cell of a plain area, ``h3id, n, logn, value``, from sets of its level."""
    if is_compact(aoi) or is_runs(aoi):
        raise ValueError("the area must give one row per cell")
    cell = f"h{level}"
    counts = sets.groupBy("cell").agg(F.sum(F.bitmap_count("taxa")).alias("_taxa"))
    area = zones_per_area_cell(aoi, cell).withColumnRenamed(cell, "cell")
    met = counts.join(area, "cell")
    return log_normalise(met.select(F.col("cell").alias("h3id"), (F.col("_taxa") * F.col("_zones")).alias("n")))


def zonal_richness(
    sets: DataFrame,
    aoi: DataFrame,
    level: int,
    id_column: str = "id",
    mode: str = "occupancy",
    coarsest: int | None = None,
) -> DataFrame:
    """Richness per zone, ``id, n, logn, value``, from stored sets.

    A plain area is met with sets of its level. A compact one is met with those of
    ``with_coarser`` or ``listed_sets``, from ``coarsest`` on: a block inside a zone is one set,
    whatever it holds, so work follows the outlines of zones.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    require_columns(aoi, id_column)
    if is_runs(aoi):
        raise ValueError("runs hold no cells; use a plain or compact area")
    if is_compact(aoi):
        if coarsest is None:
            raise ValueError("a compact area needs the coarsest level of the sets")
        area = blocks_from(aoi, coarsest)
    else:
        area = aoi.withColumnRenamed(f"h{level}", "cell")
    met = sets.join(area.select("cell", id_column), "cell")
    if mode == "occupancy":
        counts = met.groupBy(id_column).agg(F.sum("pairs").alias("n"))
    elif "positions" in sets.columns:
        taxa = met.select(id_column, "bucket", F.explode("positions").alias("_position")).distinct()
        counts = taxa.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    else:
        merged = met.groupBy(id_column, "bucket").agg(F.bitmap_or_agg("taxa").alias("taxa"))
        counts = merged.groupBy(id_column).agg(F.sum(F.bitmap_count("taxa")).alias("n"))
    return log_normalise(counts)


def by_base_cell(sets: DataFrame) -> DataFrame:
    """Sets of any level of the native grid with their base cell, ready for ``write_compact``."""
    return sets.withColumn("h0", ancestor("cell", 0))
