"""Every operator as a query over the given tables, with its expected result.

``QUERIES`` maps a name to a function of (spark, folder of the tables);
``ORACLES`` maps a name to SQL for the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellzonal.functions import geometry as geo, grid, h3, style
from cellzonal.operators import bitmaps, cache, joins, layers, publish, stats, taxa
from cellzonal.operators.grids import DictionaryGrid
from cellzonal.operators.exact import spatial_join
from cellzonal.operators.polyfill import (
    base_grid,
    compact_fill,
    polyfill,
    polyfill_retrying,
    run_area,
)
from cellzonal.plans import prepare
from cellzonal.plans.carbon import hex_carbon, zonal_carbon
from cellzonal.plans.ranges import detail_table, range_hex_richness, range_zonal_richness
from cellzonal.plans.richness import hex_richness, species_table, zonal_richness
from cellzonal.session import settle, shared_folder
from cellzonal.sources import features, tables as sources
from workload import oracle as o, tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CARBON_LEVEL = 5
KINGDOM = {"kingdom": "ECONOMY"}
COUNTRY = "C2"


def query(name: str, expected: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if expected is not None:
            ORACLES[name] = expected
        return fn

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def rounded_means(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded after a nudge, as the sum of a mean depends on row order."""
    return df.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in columns})


def with_extent(df: DataFrame, geometry: str) -> DataFrame:
    """Geometry replaced by its extent, which SQL can state."""
    b = geo.bounds_of(F.col(geometry))
    return df.withColumns(
        {c: F.round(b[c], 6) for c in ("xmin", "ymin", "xmax", "ymax")}
    ).drop(geometry)


def carbon(spark: SparkSession, sf: str) -> DataFrame:
    """Carbon facts ready for use: cleaned, with all coarser cells."""
    raw = t.carbon_raw(spark, sf, CARBON_LEVEL)
    clean = prepare.clean_values(raw, level=CARBON_LEVEL)
    return prepare.with_parents(clean, CARBON_LEVEL, range(1, CARBON_LEVEL))


def country(spark: SparkSession, sf: str) -> DataFrame:
    return layers.feature_by_id(
        t.countries(spark, sf), COUNTRY, layers.LAYERS["country_layer"]
    )


REGIONS, OVERLAP = o.sql("REGIONS"), (
    f"SELECT id, part, ax, ay, mx, my, cx, cy FROM ({o.sql('REGIONS')}) r0 UNION ALL "
    f"SELECT id, part, ax, ay, mx, my, cx, cy FROM ({o.sql('SHIFTED_REGIONS')}) r1"
)
COUNTRY_SQL = f"SELECT * FROM ({o.sql('COUNTRIES')}) c9 WHERE id = '{COUNTRY}'"
CHILD_REGIONS = f"SELECT * FROM ({REGIONS}) r9 WHERE country = '{COUNTRY}'"
EXTENT_SQL = (
    "round(least(ax, mx, cx), 6) AS xmin, round(least(ay, my, cy), 6) AS ymin, "
    "round(greatest(ax, mx, cx), 6) AS xmax, round(greatest(ay, my, cy), 6) AS ymax"
)

# -- richness ----------------------------------------------------------------------


@query("zonal_richness_occupancy", o.zonal_richness(REGIONS, 3, where="kingdom = 'ECONOMY'"))
def _(spark, sf):
    aoi = polyfill(t.regions(spark, sf), 3)
    facts = t.occurrences(spark, sf, 3, ranks=True)
    return rounded(zonal_richness(facts, aoi, 3, taxa=KINGDOM), "logn", "value")


@query("zonal_richness_species", o.zonal_richness(OVERLAP, 3, mode="species"))
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    result = zonal_richness(t.occurrences(spark, sf, 3), aoi, 3, mode="species")
    return rounded(result, "logn", "value")


@query("zonal_richness_children", o.zonal_richness(CHILD_REGIONS, 5))
def _(spark, sf):
    children = layers.child_polygons(country(spark, sf), "country_layer", t.layers(spark, sf))
    aoi = polyfill(children, 5)
    return rounded(zonal_richness(t.occurrences(spark, sf, 5), aoi, 5), "logn", "value")


@query(
    "zonal_richness_geometry",
    f"SELECT z.id, n, logn, value, {EXTENT_SQL} FROM ({o.zonal_richness(REGIONS, 3)}) s "
    f"JOIN ({REGIONS}) z ON z.id = s.id",
)
def _(spark, sf):
    zones = t.regions(spark, sf)
    result = zonal_richness(t.occurrences(spark, sf, 3), polyfill(zones, 3), 3, zones=zones)
    return with_extent(rounded(result, "logn", "value"), "geom")


@query(
    "zonal_richness_tracts",
    f"SELECT z.FIPS, s.n, s.logn, s.value FROM ({o.sql('TRACTS')}) z "
    f"LEFT JOIN ({o.zonal_richness(o.sql('TRACTS'), 4, key='FIPS')}) s ON z.FIPS = s.FIPS",
)
def _(spark, sf):
    zones = t.tracts(spark, sf)
    aoi = polyfill(zones, 4, ["FIPS"])
    result = zonal_richness(
        t.occurrences(spark, sf, 4), aoi, 4, "FIPS", zones=zones, keep_empty=True
    )
    return rounded(result.drop("geom"), "logn", "value")


@query("zonal_richness_compact", o.zonal_richness(o.sql("COUNTIES"), 6))
def _(spark, sf):
    aoi = settle(compact_fill(t.counties(spark, sf), 6))
    return rounded(zonal_richness(t.occurrences(spark, sf, 6), aoi, 6), "logn", "value")


# At level 8 the plain cells of one country number a quarter of a billion, so the
# expected results test the centres of the facts' cells.
OCCURRENCES_8 = o.occurrences(8)


@query(
    "zonal_richness_children_l8",
    o.zonal_richness(CHILD_REGIONS, 8, area=o.fact_cells(OCCURRENCES_8, CHILD_REGIONS, 8)),
)
def _(spark, sf):
    children = layers.child_polygons(country(spark, sf), "country_layer", t.layers(spark, sf))
    aoi = settle(run_area(children, 8))
    return rounded(zonal_richness(t.occurrences(spark, sf, 8), aoi, 8), "logn", "value")


@query(
    "zonal_richness_children_l8_compact",
    o.zonal_richness(CHILD_REGIONS, 8, area=o.fact_cells(OCCURRENCES_8, CHILD_REGIONS, 8)),
)
def _(spark, sf):
    children = layers.child_polygons(country(spark, sf), "country_layer", t.layers(spark, sf))
    aoi = settle(compact_fill(children, 8))
    return rounded(zonal_richness(t.occurrences(spark, sf, 8), aoi, 8), "logn", "value")


@query("zonal_richness_base", o.zonal_richness(REGIONS, 0))
def _(spark, sf):
    aoi = polyfill(t.regions(spark, sf), 0)
    return rounded(zonal_richness(t.occurrences(spark, sf, 0), aoi, 0), "logn", "value")


@query(
    "hex_richness_country_l8",
    o.hex_richness(COUNTRY_SQL, 8, area=o.fact_cells(OCCURRENCES_8, COUNTRY_SQL, 8)),
)
def _(spark, sf):
    aoi = settle(run_area(country(spark, sf), 8))
    facts = t.occurrences(spark, sf, 8)
    return rounded(hex_richness(facts, aoi, 8, geometry=False), "logn", "value")


@query("hex_richness", o.hex_richness(REGIONS, 3))
def _(spark, sf):
    aoi = polyfill(t.regions(spark, sf), 3)
    return rounded(
        hex_richness(t.occurrences(spark, sf, 3), aoi, 3, geometry=False), "logn", "value"
    )


@query("hex_richness_overlap", o.hex_richness(OVERLAP, 3))
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    return rounded(
        hex_richness(t.occurrences(spark, sf, 3), aoi, 3, geometry=False), "logn", "value"
    )


@query("hex_richness_country", o.hex_richness(COUNTRY_SQL, 5))
def _(spark, sf):
    aoi = polyfill(country(spark, sf), 5)
    return rounded(
        hex_richness(t.occurrences(spark, sf, 5), aoi, 5, geometry=False), "logn", "value"
    )


def _side(axis: str, step: int, n: int, start: int) -> str:
    at = f"((h3id {'>> 28' if axis == 'y' else '>> 0'}) & {o.LOW}) + {step}"
    return f"CAST({at} AS DOUBLE)*30/{n} - {start}"


_W, _E = _side("x", 0, 27, 180), _side("x", 1, 27, 180)
_S, _N = _side("y", 0, 27, 90), _side("y", 1, 27, 90)


@query(
    "hex_richness_boundary",
    f"SELECT h3id, n, printf('POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', "
    f"{_W}, {_S}, {_E}, {_S}, {_E}, {_N}, {_W}, {_N}, {_W}, {_S}) AS wkt "
    f"FROM ({o.hex_richness(REGIONS, 3, where='kingdom = ' + chr(39) + 'ECONOMY' + chr(39), ranks=True)}) h",
)
def _(spark, sf):
    aoi = polyfill(t.regions(spark, sf), 3)
    facts = t.occurrences(spark, sf, 3, ranks=True)
    result = hex_richness(facts, aoi, 3, KINGDOM)
    return result.select("h3id", "n", geo.to_wkt(F.col("geom")).alias("wkt"))


SPECIES_SQL = f"""
SELECT {o.RANK_SQL}, taxonkey, count(*) AS n FROM (
  SELECT DISTINCT o.* , a.id FROM ({o.occurrences(3, ranks=True)}) o
  JOIN ({o.cells(OVERLAP, 3)}) a ON o.cell = a.cell) d
GROUP BY kingdom, phylum, class, ordr, family, genus, species, taxonkey
"""


@query("species_table", SPECIES_SQL)
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    return species_table(t.occurrences(spark, sf, 3, ranks=True), aoi, 3)


@query("top_species", f"SELECT * FROM ({SPECIES_SQL}) s ORDER BY n DESC, taxonkey NULLS FIRST LIMIT 25")
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    return stats.most_common(species_table(t.occurrences(spark, sf, 3, ranks=True), aoi, 3), 25)


@query(
    "spatial_cell_join",
    f"SELECT o.cell AS h4, o.taxonkey, a.id FROM ({o.occurrences(4)}) o "
    f"JOIN ({o.cells(o.sql('COUNTIES'), 4)}) a ON o.cell = a.cell",
)
def _(spark, sf):
    aoi = polyfill(t.counties(spark, sf), 4).drop("h0")
    return joins.cell_join(t.occurrences(spark, sf, 4), aoi, 4)


@query(
    "spatial_exact_join",
    f"SELECT p.taxonkey, p.lng, p.lat, z.id FROM ({o.sql('OCCURRENCES')}) p JOIN ({o.sql('COUNTIES')}) z "
    f"ON ({o.crosses('a', 'm', 'lng', 'lat')} + {o.crosses('m', 'c', 'lng', 'lat')} + {o.crosses('c', 'a', 'lng', 'lat')}) % 2 = 1",
)
def _(spark, sf):
    found = spatial_join(t.occurrence_points(spark, sf), t.counties(spark, sf))
    return found.select("taxonkey", "lng", "lat", "id")


@query(
    "exact_against_cells",
    f"""SELECT z.id, CAST(count(*) AS BIGINT) AS by_shape,
      CAST(count(*) FILTER (WHERE c.cell IS NOT NULL) AS BIGINT) AS by_both
    FROM ({o.sql('OCCURRENCES')}) p JOIN ({o.sql('COUNTIES')}) z
    ON ({o.crosses('a', 'm', 'lng', 'lat')} + {o.crosses('m', 'c', 'lng', 'lat')} + {o.crosses('c', 'a', 'lng', 'lat')}) % 2 = 1
    LEFT JOIN ({o.cells(o.sql('COUNTIES'), 6)}) c ON c.id = z.id AND c.cell = {o.cell('p.lng', 'p.lat', 6)}
    GROUP BY z.id""",
)
def _(spark, sf):
    """How many points in a zone its cells have as well: what the cell rule gives away."""
    zones = t.counties(spark, sf)
    found = spatial_join(t.occurrence_points(spark, sf), zones)
    found = found.select("id", grid.cell_at("lng", "lat", 6).alias("h6"))
    cells = run_area(zones, 6).withColumn("both", F.lit(True))
    return (
        joins.meet(found, cells, 6, ["both"], how="left", on=["id"])
        .groupBy("id")
        .agg(F.count("*").alias("by_shape"), F.count("both").alias("by_both"))
    )


@query("run_cell_join", f"SELECT o.cell AS h6, o.taxonkey, a.id FROM ({o.occurrences(6)}) o JOIN ({o.cells(o.sql('COUNTIES'), 6)}) a ON o.cell = a.cell")
def _(spark, sf):
    aoi = run_area(t.counties(spark, sf), 6)
    return joins.cell_join(t.occurrences(spark, sf, 6), aoi, 6).select("h6", "taxonkey", "id")


@query("species_table_runs", SPECIES_SQL)
def _(spark, sf):
    aoi = run_area(t.overlap(spark, sf), 3)
    return species_table(t.occurrences(spark, sf, 3, ranks=True), aoi, 3)


@query("zonal_richness_runs", o.zonal_richness(OVERLAP, 5, "species"))
def _(spark, sf):
    aoi = run_area(t.overlap(spark, sf), 5)
    found = zonal_richness(t.occurrences(spark, sf, 5), aoi, 5, mode="species")
    return rounded(found, "logn", "value")


@query("hex_richness_runs", o.hex_richness(OVERLAP, 4))
def _(spark, sf):
    aoi = run_area(t.overlap(spark, sf), 4)
    found = hex_richness(t.occurrences(spark, sf, 4), aoi, 4, geometry=False)
    return rounded(found, "logn", "value")


# -- carbon ------------------------------------------------------------------------


@query("hex_carbon", o.mean_value(REGIONS, CARBON_LEVEL, 3, "h3id"))
def _(spark, sf):
    aoi = polyfill(t.regions(spark, sf), 3)
    return rounded_means(hex_carbon(carbon(spark, sf), aoi, 3, geometry=False), "carbon", "value")


@query("hex_carbon_country", o.mean_value(COUNTRY_SQL, CARBON_LEVEL, 5, "h3id"))
def _(spark, sf):
    aoi = polyfill(country(spark, sf), 5)
    return rounded_means(hex_carbon(carbon(spark, sf), aoi, 5, geometry=False), "carbon", "value")


@query(
    "hex_carbon_country_l8",
    o.mean_value(COUNTRY_SQL, 8, 8, "h3id", area=o.fact_cells(o.carbon(8), COUNTRY_SQL, 8)),
)
def _(spark, sf):
    raw = t.carbon_raw(spark, sf, 8)
    facts = prepare.clean_values(raw)
    aoi = settle(run_area(country(spark, sf), 8))
    return rounded_means(hex_carbon(facts, aoi, 8, geometry=False), "carbon", "value")


@query("zonal_carbon_runs", o.mean_value(OVERLAP, CARBON_LEVEL, 5, "id"))
def _(spark, sf):
    aoi = run_area(t.overlap(spark, sf), 5)
    return rounded_means(zonal_carbon(carbon(spark, sf), aoi, 5), "carbon", "value")


@query("zonal_carbon", o.mean_value(OVERLAP, CARBON_LEVEL, 4, "id"))
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 4)
    return rounded_means(zonal_carbon(carbon(spark, sf), aoi, 4), "carbon", "value")


# -- range maps --------------------------------------------------------------------

COARSE_ROWS = o.range_rows(OVERLAP, 2)
FINE_ROWS = o.range_rows(OVERLAP, 3)
BUILDING = {"kingdom": "BUILDING"}


def _overlap_cells(spark, sf, level):
    return polyfill(t.overlap(spark, sf), level)


def _scaled(df):
    return rounded(df, "logn", "value")


@query("range_hex_richness", o.range_stat(COARSE_ROWS, "h3id"))
def _(spark, sf):
    aoi = _overlap_cells(spark, sf, 2)
    return _scaled(range_hex_richness(t.range_cells(spark, sf), aoi, geometry=False))


@query("range_hex_richness_fine", o.range_stat(FINE_ROWS, "h3id"))
def _(spark, sf):
    aoi = _overlap_cells(spark, sf, 3)
    return _scaled(range_hex_richness(t.range_cells(spark, sf), aoi, geometry=False))


@query("range_hex_richness_distinct", o.range_stat(o.range_rows(OVERLAP, 1), "h3id", distinct=True))
def _(spark, sf):
    aoi = _overlap_cells(spark, sf, 1)
    return _scaled(
        range_hex_richness(t.range_cells(spark, sf), aoi, distinct=True, geometry=False)
    )


@query("range_hex_richness_rollup", o.range_stat(o.range_rows(OVERLAP, 1), "h3id"))
def _(spark, sf):
    data = t.range_cells(spark, sf).select("taxon_id", "h2")
    return _scaled(range_hex_richness(data, _overlap_cells(spark, sf, 1), geometry=False))


@query(
    "range_zonal_richness",
    o.range_stat(o.range_rows(OVERLAP, 2, where="kingdom = 'BUILDING'"), "id"),
)
def _(spark, sf):
    aoi = _overlap_cells(spark, sf, 2)
    data, names = t.range_cells(spark, sf), t.range_taxa(spark, sf)
    return _scaled(range_zonal_richness(data, aoi, taxonomy=names, taxa=BUILDING))


@query("range_zonal_richness_fine", o.range_stat(FINE_ROWS, "id"))
def _(spark, sf):
    return _scaled(range_zonal_richness(t.range_cells(spark, sf), _overlap_cells(spark, sf, 3)))


@query("range_zonal_richness_distinct", o.range_stat(FINE_ROWS, "id", distinct=True))
def _(spark, sf):
    aoi = _overlap_cells(spark, sf, 3)
    return _scaled(range_zonal_richness(t.range_cells(spark, sf), aoi, distinct=True))


DETAIL_SQL = (
    f"SELECT h3id, id, taxon_id, fine AS h2, {o.up('fine', 2, 1)} AS h1, {o.up('fine', 2, 0)} AS h0 "
    f"FROM ({o.range_rows(REGIONS, 3, where=chr(39) + 'BUILDING' + chr(39) + ' = kingdom')}) j"
)


def _detail(spark, sf, rows=None):
    aoi = polyfill(t.regions(spark, sf), 3)
    names = t.range_taxa(spark, sf)
    return detail_table(t.range_cells(spark, sf), aoi, names, BUILDING, rows)


@query("range_detail_table", DETAIL_SQL)
def _(spark, sf):
    return _detail(spark, sf)


@query(
    "range_detail_preview",
    f"SELECT * FROM ({DETAIL_SQL}) d ORDER BY id, h3id, taxon_id, h2 LIMIT 100",
)
def _(spark, sf):
    return publish.preview(_detail(spark, sf).orderBy("id", "h3id", "taxon_id", "h2"))


# -- taxonomy ----------------------------------------------------------------------

TAXA_SQL = o.sql("TAXA")


@query(
    "taxa_filter_facts",
    f"SELECT taxonkey, cell AS h3, species FROM ({o.occurrences(3, ranks=True)}) f "
    "WHERE kingdom = 'ECONOMY' AND phylum = 'ECONOMY/Brand#2'",
)
def _(spark, sf):
    facts = t.occurrences(spark, sf, 3, ranks=True)
    chosen = {"kingdom": "ECONOMY", "phylum": "ECONOMY/Brand#2", "no_such_rank": "x"}
    return taxa.filter_taxa(facts, chosen).select("taxonkey", "h3", "species")


@query("taxa_filter_dim", f"SELECT taxon_id, fine AS h2 FROM ({o.ranges(2, chr(39) + 'BUILDING' + chr(39) + ' = kingdom')}) d")
def _(spark, sf):
    facts = t.range_cells(spark, sf).select("taxon_id", "h2")
    return taxa.filter_by_taxonomy(facts, t.range_taxa(spark, sf), BUILDING)


@query("root_taxa", f"SELECT DISTINCT kingdom FROM ({TAXA_SQL}) x WHERE kingdom IS NOT NULL")
def _(spark, sf):
    return taxa.root_taxa(t.taxa(spark, sf))


@query(
    "child_taxa",
    f"SELECT DISTINCT ordr AS \"order\" FROM ({TAXA_SQL}) x "
    "WHERE class = 'ECONOMY/Brand#17/28' AND ordr IS NOT NULL",
)
def _(spark, sf):
    return taxa.child_taxa(t.taxa(spark, sf), "class", "ECONOMY/Brand#17/28")


@query(
    "child_taxa_top",
    f"SELECT DISTINCT phylum FROM ({TAXA_SQL}) x WHERE kingdom = 'ECONOMY' AND phylum IS NOT NULL",
)
def _(spark, sf):
    return taxa.child_taxa(t.taxa(spark, sf), "kingdom", "ECONOMY")


@query(
    "taxonomy_lookup",
    f"SELECT DISTINCT kingdom, phylum, class, ordr AS \"order\", family FROM ({TAXA_SQL}) x "
    "WHERE family = 'ECONOMY/Brand#17/28/red/widget'",
)
def _(spark, sf):
    return taxa.lineage(t.taxa(spark, sf), "family", "ECONOMY/Brand#17/28/red/widget")


@query(
    "taxonomy_lineages",
    f"SELECT DISTINCT kingdom, phylum, class FROM ({TAXA_SQL}) x WHERE class = 'ECONOMY/Brand#17/28'",
)
def _(spark, sf):
    return taxa.lineage(t.taxa(spark, sf), "class", "ECONOMY/Brand#17/28")


REQUESTS = """
SELECT p_partkey AS request, CASE p_partkey % 7 WHEN 0 THEN ' Birds' WHEN 1 THEN 'ALL ' WHEN 2 THEN 'crows'
  WHEN 3 THEN 'Homo sapiens' WHEN 4 THEN NULL ELSE p_name END AS phrase FROM {part}
"""


def _named(rank: str) -> str:
    pairs = [(p, names[rank]) for p, names in taxa.ALIASES.items() if rank in names]
    whens = " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in pairs)
    return f"CASE lower(trim(phrase)) {whens} END AS \"{rank}\""


@query(
    "alias_lookup",
    f"SELECT request, phrase, {', '.join(_named(r) for r in taxa.RANKS)}, "
    f"coalesce(lower(trim(phrase)) IN ({', '.join(repr(p) for p in taxa.ALIASES)}), FALSE) AS known "
    f"FROM ({t.duck(REQUESTS)}) q",
)
def _(spark, sf):
    return taxa.resolve_aliases(t.derive(spark, sf, REQUESTS), taxa.alias_table(spark))


_PROPOSED = {
    "kingdom": "kingdom",
    "phylum": "CASE WHEN taxonkey % 4 = 2 THEN 'none such' ELSE phylum END",
    "class": "CASE WHEN taxonkey % 4 = 3 THEN NULL ELSE class END",
    "ordr": "CASE WHEN taxonkey % 4 = 1 THEN NULL ELSE ordr END",
    "family": "family",
    "genus": "CASE WHEN taxonkey % 4 = 0 THEN genus ELSE NULL END",
    "species": "CASE WHEN taxonkey % 4 = 0 THEN species ELSE NULL END",
}
PROPOSALS = (
    "SELECT taxonkey AS request, "
    + ", ".join(
        f"CASE WHEN taxonkey % 13 = 0 THEN NULL ELSE {e} END AS {r}" for r, e in _PROPOSED.items()
    )
    + f" FROM ({t.TAXA}) x"
)


@query(
    "lineage_check",
    f"SELECT request, EXISTS (SELECT 1 FROM ({TAXA_SQL}) y WHERE "
    + " AND ".join(f"(p.{r} IS NULL OR p.{r} = y.{r})" for r in _PROPOSED)
    + f") AS found FROM ({t.duck(PROPOSALS)}) p",
)
def _(spark, sf):
    proposals = t.derive(spark, sf, PROPOSALS).withColumnRenamed("ordr", "order")
    return taxa.check_lineage(proposals, t.taxa(spark, sf), "request")


@query(
    "classification_parse",
    f"SELECT taxonkey AS request, {o.RANK_SQL}, taxonkey % 5 <> 0 AS valid FROM ({TAXA_SQL}) x",
)
def _(spark, sf):
    extra = F.when(F.col("taxonkey") % 5 == 0, F.lit("x")).alias("common_name")
    ranks = [F.col(f"`{r}`") for r in taxa.RANKS]
    texts = t.taxa(spark, sf).select(
        F.col("taxonkey").alias("request"), F.to_json(F.struct(*ranks, extra)).alias("json")
    )
    return taxa.parse_classification(texts)


@query(
    "selection_table",
    " UNION ALL ".join(
        f"SELECT taxonkey, '{r.title()}' AS \"Rank\", {'ordr' if r == 'order' else r} AS \"Selection\" "
        f"FROM ({TAXA_SQL}) x WHERE {'ordr' if r == 'order' else r} IS NOT NULL"
        for r in taxa.RANKS
    ),
)
def _(spark, sf):
    return taxa.selection_rows(t.taxa(spark, sf), ["taxonkey"])


@query(
    "selection_text",
    "SELECT taxonkey, CASE WHEN taxonkey % 6 = 0 THEN 'No selection made' ELSE concat_ws(chr(10), "
    + ", ".join(f"'{r.title()}: ' || {'ordr' if r == 'order' else r}" for r in taxa.RANKS)
    + f") END AS selection FROM ({TAXA_SQL}) x",
)
def _(spark, sf):
    names = t.taxa(spark, sf)
    cleared = names.withColumns(
        {r: F.when(F.col("taxonkey") % 6 != 0, F.col(f"`{r}`")) for r in taxa.RANKS}
    )
    return cleared.select("taxonkey", taxa.selection_text_column().alias("selection"))


@query(
    "normalised_selections",
    "SELECT taxonkey, kingdom, phylum, CASE WHEN taxonkey % 4 = 0 THEN NULL ELSE class END AS class, "
    'ordr AS "order", CASE WHEN taxonkey % 3 = 0 THEN NULL ELSE family END AS family, genus, species '
    f"FROM ({TAXA_SQL}) x",
)
def _(spark, sf):
    blank = {"class": F.col("taxonkey") % 4 == 0, "family": F.col("taxonkey") % 3 == 0}
    given = t.taxa(spark, sf).withColumns(
        {r: F.when(unset, "").otherwise(F.col(r)) for r, unset in blank.items()}
    )
    return given.select("taxonkey", *[c.alias(r) for r, c in taxa.normalised_columns().items()])


@query(
    "chosen_ranks",
    """
    SELECT taxonkey,
        CASE taxonkey % 4 WHEN 1 THEN 'Chosen' ELSE kingdom END AS kingdom,
        CASE taxonkey % 4 WHEN 1 THEN NULL ELSE phylum END AS phylum,
        CASE taxonkey % 4 WHEN 1 THEN NULL WHEN 2 THEN 'Chosen' ELSE class END AS class,
        CASE WHEN taxonkey % 4 IN (1, 2) THEN NULL ELSE ordr END AS "order",
        CASE WHEN taxonkey % 4 IN (1, 2) THEN NULL ELSE family END AS family,
        CASE WHEN taxonkey % 4 IN (1, 2) THEN NULL ELSE genus END AS genus,
        CASE taxonkey % 4 WHEN 0 THEN species END AS species
    """
    f"FROM ({TAXA_SQL}) x",
)
def _(spark, sf):
    """Every fourth row chooses a kingdom, a class, clears its species, or chooses nothing."""
    turn = F.col("taxonkey") % 4
    rank = F.when(turn == 1, "kingdom").when(turn == 2, "class").when(turn == 3, "species")
    name = F.when(turn == 3, "").otherwise("Chosen")
    chosen = taxa.set_rank_columns(rank, name)
    return t.taxa(spark, sf).select("taxonkey", *[c.alias(r) for r, c in chosen.items()])


@query(
    "zoom_levels",
    "SELECT event_id, CASE WHEN value IS NOT NULL "
    "THEN CAST(greatest(1, least(10, trunc(value / 4 - 2))) AS INTEGER) END AS level FROM events",
)
def _(spark, sf):
    zooms = spark.read.parquet(f"{sf}/events.parquet")
    return zooms.select("event_id", grid.zoom_to_level_column("value / 4 - 2").alias("level"))


# -- layers ------------------------------------------------------------------------


def _extent_of(sql: str, columns: str) -> str:
    return f"SELECT {columns}, {EXTENT_SQL} FROM ({sql}) z"


@query("child_layer", _extent_of(f"SELECT * FROM ({o.sql('COUNTIES')}) c WHERE region = 'N7'", 'id, region, "primary"'))
def _(spark, sf):
    config = layers.LAYERS["region_layer"]
    parent = layers.feature_by_id(t.regions(spark, sf), 7, config)
    children = layers.child_polygons(parent, "region_layer", t.layers(spark, sf))
    return with_extent(children, "geometry")


@query(
    "grandchild_layer",
    _extent_of(
        f"SELECT * FROM ({o.sql('TRACTS')}) t WHERE COUNTY IN "
        f"(SELECT \"primary\" FROM ({o.sql('COUNTIES')}) c WHERE region = 'N7')",
        "FIPS, COUNTY",
    ),
)
def _(spark, sf):
    tables = t.layers(spark, sf)
    region = layers.feature_by_id(tables["region_layer"], 7, layers.LAYERS["region_layer"])
    counties = layers.child_polygons(region, "region_layer", tables)
    tracts = layers.children_of(counties, tables["tract_layer"], layers.LAYERS["county_layer"])
    return with_extent(tracts.drop("id"), "geometry")


@query("feature_by_id", _extent_of(f"SELECT * FROM ({o.sql('TRACTS')}) t WHERE id = 'F42'", "FIPS, id, COUNTY"))
def _(spark, sf):
    found = layers.feature_by_id(t.tracts(spark, sf), "F42", layers.LAYERS["tract_layer"])
    return with_extent(found, "geometry")


@query("gap_filter", f"SELECT row_n, GAP_Sts FROM ({o.sql('PROTECTED')}) p WHERE GAP_Sts IN ('1', '2', '3')")
def _(spark, sf):
    areas = t.protected_areas(spark, sf)
    kept = layers.apply_filter(areas, layers.LayerFilter("GAP_Sts", "in", layers.GAP_INITIAL))
    return kept.select("row_n", "GAP_Sts")


@query(
    "compound_layer_filter",
    f"SELECT * FROM ({o.sql('PROTECTED')}) p WHERE Mang_Type = 'FED' AND GAP_Sts IN ('1', '2')",
)
def _(spark, sf):
    conditions = [
        layers.LayerFilter("Mang_Type", "==", "FED"),
        layers.LayerFilter("GAP_Sts", "in", layers.GAP_DRAWN),
    ]
    return layers.apply_filter(t.protected_areas(spark, sf), conditions)


@query(
    "member_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN "
    "(SELECT p_partkey FROM part WHERE p_type = 'PROMO')",
)
def _(spark, sf):
    promo = t.read(spark, sf, "part").where("p_type = 'PROMO'").select("p_partkey")
    rows = t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return layers.members(rows, "l_partkey", promo).drop("l_partkey")


@query("active_feature", _extent_of(o.sql("COUNTIES"), 'id, region, "primary"'))
def _(spark, sf):
    counties = t.counties(spark, sf)
    selected = counties.where("id < 0")
    chosen = layers.first_non_empty([selected, None, counties], t.regions(spark, sf))
    return with_extent(chosen, "geometry")


# -- grid and geometry ---------------------------------------------------------------


def _aoi_sql(corners: str, r: int, key: str = "id") -> str:
    return f"SELECT {o.up('cell', r, 0)} AS h0, cell AS h{r}, {key} FROM ({o.cells(corners, r, key)}) a"


@query("aoi_cells", _aoi_sql(o.sql("COUNTIES"), 4))
def _(spark, sf):
    return polyfill(t.counties(spark, sf), 4)


@query(
    "aoi_cells_compact",
    f"SELECT id, count(*) AS cells FROM ({o.cells(o.sql('COUNTIES'), 6)}) a GROUP BY id",
)
def _(spark, sf):
    own = "shiftright(cell, 56)"
    blocks = compact_fill(t.counties(spark, sf), 6)
    size = F.expr(f"cast(pow(9, 6 - {own}) as bigint)")
    return blocks.groupBy("id").agg(F.sum(size).alias("cells"))


@query("aoi_cells_fine", _aoi_sql(o.sql("TRACTS"), 6, "FIPS"))
def _(spark, sf):
    return polyfill(t.tracts(spark, sf), 6, ["FIPS"])


@query("aoi_cells_multipart", _aoi_sql(o.sql("COUNTRIES"), 3))
def _(spark, sf):
    return polyfill(t.countries(spark, sf), 3)


@query(
    "aoi_cells_merged",
    f"SELECT DISTINCT {o.up('cell', 3, 0)} AS h0, cell AS h3 FROM ({o.cells(o.sql('COUNTIES'), 3)}) a",
)
def _(spark, sf):
    return polyfill(t.counties(spark, sf), 3, [])


_INNER = ", ".join(
    f"{p}{a}/2 + (a{a} + m{a} + c{a})/6 AS {p}{a}" for p in "amc" for a in "xy"
)
INNER_COUNTIES = f"SELECT id, part, {_INNER} FROM ({t.COUNTIES}) z"


@query(
    "aoi_cells_hole",
    _aoi_sql(o.sql("COUNTIES"), 5) + " EXCEPT " + _aoi_sql(t.duck(INNER_COUNTIES), 5),
)
def _(spark, sf):
    holes = t.derive(spark, sf, INNER_COUNTIES).select("id", t.triangle().alias("hole"))
    zones = t.counties(spark, sf).join(holes, "id")
    part = F.concat(F.col("geometry")[0], F.col("hole"))
    return polyfill(zones.select("id", F.array(part).alias("geometry")), 5)


BOXES = """
SELECT c_custkey AS id, -190.37e0 + (c_custkey % 37)*10 AS xmin, -95.21e0 + (c_custkey % 19)*9 AS ymin,
       -190.37e0 + (c_custkey % 37)*10 + 15.11e0 AS xmax, -95.21e0 + (c_custkey % 19)*9 + 24.13e0 AS ymax
FROM {customer}
"""


@query(
    "bbox_cells",
    f"""
    SELECT {o.up('cell', 3, 0)} AS h0, cell AS h3, id FROM (
      SELECT b.id, {3 * o.L} + y*{o.R} + x AS cell FROM ({t.duck(BOXES)}) b
      JOIN (SELECT unnest(range(0, 324)) AS x) xs
        ON (CAST(x AS DOUBLE) + 0.5e0)*30/27 - 180 >= greatest(xmin, -178)
       AND (CAST(x AS DOUBLE) + 0.5e0)*30/27 - 180 < least(xmax, 178)
      JOIN (SELECT unnest(range(0, 162)) AS y) ys
        ON (CAST(y AS DOUBLE) + 0.5e0)*30/27 - 90 >= greatest(ymin, -89.99e0)
       AND (CAST(y AS DOUBLE) + 0.5e0)*30/27 - 90 < least(ymax, 89.99e0)) b4
    """,
)
def _(spark, sf):
    return polyfill(features.views(t.derive(spark, sf, BOXES)), 3)


def _back(corners: str) -> str:
    """Corners moved once around the globe to the west."""
    return f"SELECT id, part, ax - 360 AS ax, ay, mx - 360 AS mx, my, cx - 360 AS cx, cy FROM ({corners}) w"


BOTH_SIDES = f"{o.sql('DATE_LINE')} UNION ALL {_back(o.sql('DATE_LINE'))}"


@query("aoi_cells_date_line", _aoi_sql(BOTH_SIDES, 5))
def _(spark, sf):
    """Zones across the date line: the short way round, never the rest of the world."""
    return polyfill(t.date_line(spark, sf), 5)


@query("zonal_richness_date_line", o.zonal_richness(BOTH_SIDES, 5))
def _(spark, sf):
    aoi = run_area(t.date_line(spark, sf), 5)
    return _scaled(zonal_richness(t.occurrences(spark, sf, 5), aoi, 5))


@query(
    "spatial_exact_join_date_line",
    f"SELECT p.taxonkey, p.lng, p.lat, z.id FROM ({o.sql('OCCURRENCES')}) p JOIN ({BOTH_SIDES}) z "
    f"ON ({o.crosses('a', 'm', 'lng', 'lat')} + {o.crosses('m', 'c', 'lng', 'lat')} + {o.crosses('c', 'a', 'lng', 'lat')}) % 2 = 1",
)
def _(spark, sf):
    found = spatial_join(t.occurrence_points(spark, sf), t.date_line(spark, sf))
    return found.select("taxonkey", "lng", "lat", "id")


@query(
    "aoi_cells_poles",
    f"""
    SELECT z.id, CAST(count(*) AS BIGINT) AS cells FROM ({o.sql('POLES')}) z
    JOIN (SELECT unnest(range(0, 324)) AS x) xs ON TRUE
    JOIN (SELECT unnest(range(0, 162)) AS y) ys
      ON ((CAST(y AS DOUBLE) + 0.5e0)*30/27 - 90) * side > height
    GROUP BY z.id
    """,
)
def _(spark, sf):
    """Rings around a pole hold its cap."""
    return polyfill(t.poles(spark, sf), 3).groupBy("id").agg(F.count("*").alias("cells"))


def _retry_sql() -> str:
    tracts = o.sql("TRACTS")
    parts, done = [], []
    for r in (3, 4, 5):
        found = o.cells(tracts, r)
        unseen = "".join(f" AND id NOT IN (SELECT id FROM ({d}) d)" for d in done)
        parts.append(f"SELECT {r} AS level, cell, id FROM ({found}) f WHERE TRUE{unseen}")
        done.append(found)
    return " UNION ALL ".join(parts)


@query("aoi_cells_retry", _retry_sql())
def _(spark, sf):
    return polyfill_retrying(t.tracts(spark, sf), 3, 5)


@query("point_cells", f"SELECT taxonkey, {o.cell('lng', 'lat', 8)} AS h8 FROM ({o.sql('OCCURRENCES')}) p")
def _(spark, sf):
    points = t.occurrence_points(spark, sf)
    return points.select("taxonkey", grid.cell_at("lng", "lat", 8).alias("h8"))


@query(
    "parent_columns",
    "SELECT h8, " + ", ".join(f"{o.up('h8', 8, k)} AS h{k}" for k in range(8))
    + f" FROM (SELECT {o.cell('lng', 'lat', 8)} AS h8 FROM ({o.sql('OCCURRENCES')}) p) c",
)
def _(spark, sf):
    points = t.occurrence_points(spark, sf)
    cells = points.select(grid.cell_at("lng", "lat", 8).alias("h8"))
    return prepare.with_parents(cells, 8, range(8))


@query(
    "base_grid",
    f"SELECT h0, CAST(h0 & {o.LOW} AS DOUBLE)*30 - 180 AS xmin, CAST(h0 >> 28 AS DOUBLE)*30 - 90 AS ymin, "
    f"CAST(h0 & {o.LOW} AS DOUBLE)*30 - 150 AS xmax, CAST(h0 >> 28 AS DOUBLE)*30 - 60 AS ymax "
    f"FROM (SELECT DISTINCT {o.cell('lng', 'lat', 0)} AS h0 FROM ({o.sql('OCCURRENCES')}) p) c",
)
def _(spark, sf):
    return with_extent(base_grid(t.occurrences(spark, sf, 0)), "geom")


@query(
    "cell_text",
    f"SELECT lower(to_hex(h5)) AS lower_id, upper(to_hex(h5)) AS upper_id, h5 AS again FROM "
    f"(SELECT {o.cell('lng', 'lat', 5)} AS h5 FROM ({o.sql('OCCURRENCES')}) p) c",
)
def _(spark, sf):
    text = t.occurrences(spark, sf, 5).select(
        grid.to_text(F.col("h5")).alias("lower_id"), grid.to_text(F.col("h5"), True).alias("upper_id")
    )
    back = F.when(F.hash("lower_id") % 2 == 0, F.col("lower_id")).otherwise(F.col("upper_id"))
    return text.withColumn("again", grid.from_text(back))


def _h3_sql(key: str, level: int) -> str:
    """An H3 id at a resolution whose digits spell a key in base 7."""
    digits = " + ".join(
        f"(floor({key} / {7 ** (9 - i)}) % 7)*{8 ** (15 - i)}" for i in range(1, level + 1)
    )
    unused = 8 ** (15 - level) - 1
    head = (1 << 59) + (level << 52) + unused
    return f"({head} + ({key} % 122)*{1 << 45}" + (f" + CAST({digits} AS BIGINT))" if digits else ")")


H3_IDS = f"SELECT c_custkey, {_h3_sql('c_custkey', 9)} AS h9 FROM {{customer}}"


@query(
    "h3_parent",
    f"SELECT {_h3_sql('c_custkey', 9)} AS h9, {_h3_sql('c_custkey', 8)} AS h8, "
    f"{_h3_sql('c_custkey', 5)} AS h5, {_h3_sql('c_custkey', 0)} AS h0, 5 AS level FROM customer",
)
def _(spark, sf):
    ids = t.derive(spark, sf, H3_IDS)
    ids = ids.withColumn("h7", h3.parent("h9", 9, 7))
    return ids.select(
        "h9",
        h3.parent("h9", 9, 8).alias("h8"),
        h3.parent("h7", 7, 5).alias("h5"),
        h3.parent("h9", 9, 0).alias("h0"),
    ).withColumn("level", h3.resolution("h5"))


# Dictionary of H3 cells with invented centres, and facts keyed by those cells.
H3_CENTRES = f"""
SELECT {_h3_sql('c_custkey', 9)} AS cell, CAST((c_custkey*7919) % 36000 AS DOUBLE)/100 - 180 AS lng,
       CAST((c_custkey*6101) % 18000 AS DOUBLE)/100 - 90 AS lat FROM {{customer}}
"""
H3_FACTS = f"""
SELECT o_orderkey % 50 AS taxonkey, {_h3_sql('o_custkey', 9)} AS h9 FROM {{orders}}
"""


def _inside(p: str = "c") -> str:
    def crosses(a, b):
        return (
            f"CASE WHEN ({a}y > lat) <> ({b}y > lat) AND "
            f"lng < ({b}x - {a}x)*(lat - {a}y)/({b}y - {a}y) + {a}x THEN 1 ELSE 0 END"
        )

    return f"({crosses('a', 'm')} + {crosses('m', 'c')} + {crosses('c', 'a')}) % 2 = 1"


H3_CELLS_SQL = f"SELECT cell, id FROM ({t.duck(H3_CENTRES)}) c JOIN ({OVERLAP}) z ON {_inside()}"


def _h3_grid(spark, sf) -> DictionaryGrid:
    centres = t.derive(spark, sf, H3_CENTRES)
    east = F.least(F.col("lng") + 0.01, F.lit(180.0))
    north = F.least(F.col("lat") + 0.01, F.lit(90.0))
    outline = geo.box(F.col("lng"), F.col("lat"), east, north)
    return DictionaryGrid(centres.withColumn("boundary", outline))


@query(
    "h3_aoi_cells",
    f"SELECT {1 << 59} + {8 ** 15 - 1} + ((cell >> 45) & 127)*{1 << 45} AS h0, cell AS h9, id FROM ({H3_CELLS_SQL}) a",
)
def _(spark, sf):
    return _h3_grid(spark, sf).polyfill(t.overlap(spark, sf), 9)


@query(
    "h3_zonal_richness",
    o.log_value(
        f"SELECT id, count(*) AS n FROM (SELECT DISTINCT taxonkey, h9, id FROM ({t.duck(H3_FACTS)}) f "
        f"JOIN ({H3_CELLS_SQL}) a ON a.cell = f.h9) d GROUP BY id",
        "id",
    ),
)
def _(spark, sf):
    cells = _h3_grid(spark, sf)
    aoi = cells.polyfill(t.overlap(spark, sf), 9)
    return _scaled(zonal_richness(t.derive(spark, sf, H3_FACTS), aoi, 9, grid=cells))


@query(
    "h3_hex_richness",
    f"SELECT h3id, n, round(lng, 6) AS xmin, round(lat, 6) AS ymin FROM (SELECT h3id, count(*) AS n FROM "
    f"(SELECT DISTINCT taxonkey, h9 AS h3id, id FROM ({t.duck(H3_FACTS)}) f "
    f"JOIN ({H3_CELLS_SQL}) a ON a.cell = f.h9) d GROUP BY h3id) s JOIN ({t.duck(H3_CENTRES)}) c ON c.cell = h3id",
)
def _(spark, sf):
    cells = _h3_grid(spark, sf)
    aoi = cells.polyfill(t.overlap(spark, sf), 9)
    result = hex_richness(t.derive(spark, sf, H3_FACTS), aoi, 9, grid=cells)
    return with_extent(result, "geom").select("h3id", "n", "xmin", "ymin")


@query(
    "bounds",
    "SELECT region, round(min(least(ax, mx, cx)), 6) AS xmin, round(min(least(ay, my, cy)), 6) AS ymin, "
    "round(max(greatest(ax, mx, cx)), 6) AS xmax, round(max(greatest(ay, my, cy)), 6) AS ymax "
    f"FROM ({o.sql('COUNTIES')}) z GROUP BY region",
)
def _(spark, sf):
    found = stats.bounds(t.counties(spark, sf), by=["region"])
    return rounded(found, "xmin", "ymin", "xmax", "ymax")


# -- preparation -------------------------------------------------------------------

RAW_CARBON_SQL = f"SELECT {o.cell('lng', 'lat', CARBON_LEVEL)} AS h5, Z FROM ({o.sql('CARBON_POINTS')}) e"


@query("missing_profile", f"SELECT Z IS NULL AS missing, count(*) AS n FROM ({RAW_CARBON_SQL}) c GROUP BY 1")
def _(spark, sf):
    return stats.missing_profile(t.carbon_raw(spark, sf, CARBON_LEVEL), "Z")


@query(
    "quality_report",
    f"SELECT 'rows' AS \"check\", count(*) AS n FROM ({RAW_CARBON_SQL}) c UNION ALL "
    f"SELECT CASE WHEN Z IS NULL THEN 'missing' ELSE 'present' END, count(*) FROM ({RAW_CARBON_SQL}) c GROUP BY 1",
)
def _(spark, sf):
    return prepare.quality_report(t.carbon_raw(spark, sf, CARBON_LEVEL), "Z")


@query(
    "carbon_prep",
    "SELECT Z AS carbon, h5, " + ", ".join(f"{o.up('h5', 5, k)} AS h{k}" for k in range(5))
    + f" FROM ({RAW_CARBON_SQL}) c WHERE Z IS NOT NULL",
)
def _(spark, sf):
    return carbon(spark, sf)


DIVISIONS = """
SELECT s_suppkey AS id, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'country' WHEN 1 THEN 'region' ELSE 'county' END AS subtype,
       s_suppkey % 4 <> 0 AS is_land, s_name FROM {supplier}
"""


@query(
    "admin_layer_prep",
    f"SELECT id, subtype, s_name AS \"primary\" FROM ({t.duck(DIVISIONS)}) d WHERE subtype = 'region' AND is_land",
)
def _(spark, sf):
    divisions = t.derive(spark, sf, DIVISIONS)
    nested = divisions.withColumn("names", F.struct(F.col("s_name").alias("primary")))
    return prepare.admin_layer(nested, "region").select("id", "subtype", "primary")


@query("tract_prep", _extent_of(o.sql("TRACTS"), "FIPS, FIPS AS id, COUNTY"))
def _(spark, sf):
    raw = t.tracts(spark, sf).drop("id").withColumnRenamed("geometry", "Shape")
    return with_extent(prepare.tract_layer(raw), "geometry")


def _stored_carbon(spark, sf) -> DataFrame:
    """Carbon facts written once per input, partitioned by base cell."""
    source = cache.files_fingerprint(spark, f"{sf}/events.parquet")
    return cache.cached(
        spark,
        "carbon-by-base-cell",
        [source],
        {"level": CARBON_LEVEL},
        lambda: carbon(spark, sf).hint("rebalance", F.col("h0")),
        partition_by=["h0"],
    )


@query(
    "partition_pruned_scan",
    f"SELECT f.h5, f.carbon, a.h0 FROM ({RAW_CARBON_SQL.replace('Z FROM', 'Z AS carbon FROM')}) f JOIN "
    f"(SELECT DISTINCT h0 FROM ({_aoi_sql(CHILD_REGIONS, 3)}) c) a ON a.h0 = {o.up('f.h5', 5, 0)} "
    "WHERE carbon IS NOT NULL",
)
def _(spark, sf):
    children = t.regions(spark, sf).where(F.col("country") == COUNTRY)
    stored = _stored_carbon(spark, sf)
    facts = stored.withColumn("h0", F.col("h0").cast("long"))
    return sources.open_region(facts, polyfill(children, 3)).select("h5", "carbon", "h0")


@query("stored_zonal_carbon", o.mean_value(CHILD_REGIONS, CARBON_LEVEL, 4, "id"))
def _(spark, sf):
    children = t.regions(spark, sf).where(F.col("country") == COUNTRY)
    aoi = cache.cached_aoi(children, 4)
    facts = _stored_carbon(spark, sf).withColumn("h0", F.col("h0").cast("long"))
    return rounded_means(zonal_carbon(sources.open_region(facts, aoi), aoi, 4), "carbon", "value")


def _stored_occurrences(spark, sf) -> DataFrame:
    """Occurrences by base cell, whose folders are named by hexadecimal text of either case."""
    source = cache.files_fingerprint(spark, f"{sf}/lineitem.parquet")
    facts = prepare.with_parents(t.occurrences(spark, sf, 5), 5, range(5))
    upper = F.col("taxonkey") % 2 == 0
    text = F.when(upper, grid.to_text(F.col("h0"), True)).otherwise(grid.to_text(F.col("h0")))
    keyed = facts.withColumn("h0", text)
    folder = cache.stored_folder(
        spark, "occurrences", [source], {"level": 5}, lambda path: prepare.write_compact(keyed, path)
    )
    return sources.open_cells(spark, folder, keyed.schema)


def _child_regions(spark, sf) -> DataFrame:
    return t.regions(spark, sf).where(F.col("country") == COUNTRY)


def _written_by_cell(spark, sf) -> str:
    """Folder of occurrences of level 3 by base cell."""
    facts = prepare.with_parents(t.occurrences(spark, sf, 3), 3, [0])
    source = cache.files_fingerprint(spark, f"{sf}/lineitem.parquet")
    return cache.stored_folder(
        spark, "by-cell", [source], {"level": 3}, lambda path: prepare.write_compact(facts, path)
    )


@query("glob_scan", f"SELECT taxonkey, cell AS h3 FROM ({o.occurrences(3)}) f")
def _(spark, sf):
    """All files of a partitioned table through one pattern."""
    return sources.open_table(spark, f"{_written_by_cell(spark, sf)}/h0=*/*.parquet").select("taxonkey", "h3")


@query(
    "file_list_scan",
    f"SELECT taxonkey, cell AS h3, {o.up('cell', 3, 0)} AS h0 FROM ({o.occurrences(3)}) f "
    f"WHERE {o.up('cell', 3, 0)} IN (0, 3, {o.R + 5})",
)
def _(spark, sf):
    """Chosen folders of a partitioned table, with their partition column."""
    root = _written_by_cell(spark, sf)
    chosen = [f"{root}/h0={c}" for c in (0, 3, o.R + 5)]
    return sources.open_files(spark, chosen, root, "taxonkey long, h3 long, h0 long")


@query(
    "chosen_partitions",
    f"SELECT taxonkey, cell AS h3, {o.up('cell', 3, 0)} AS h0 FROM ({o.occurrences(3)}) f "
    f"WHERE {o.up('cell', 3, 0)} IN (1, {2 * o.R})",
)
def _(spark, sf):
    stored = sources.open_cells(spark, _written_by_cell(spark, sf))
    return sources.open_partitions(stored, [1, 2 * o.R]).select("taxonkey", "h3", "h0")


@query("tolerant_projection", f"SELECT kingdom, taxonkey FROM ({o.sql('TAXA')}) x")
def _(spark, sf):
    """Of the columns asked for, those that a table has."""
    return sources.any_of(t.taxa(spark, sf), ["kingdom", "subspecies", "taxonkey", "author"])


@query(
    "region_scan_text_ids",
    f"SELECT f.taxonkey, f.cell AS h5 FROM ({o.occurrences(5)}) f JOIN "
    f"(SELECT DISTINCT h0 FROM ({_aoi_sql(CHILD_REGIONS, 3)}) c) a ON a.h0 = {o.up('f.cell', 5, 0)}",
)
def _(spark, sf):
    aoi = polyfill(_child_regions(spark, sf), 3)
    return sources.open_region(_stored_occurrences(spark, sf), aoi).select("taxonkey", "h5")


@query("stored_hex_richness", o.hex_richness(CHILD_REGIONS, 4))
def _(spark, sf):
    aoi = polyfill(_child_regions(spark, sf), 4)
    facts = sources.open_region(_stored_occurrences(spark, sf), aoi).drop("h0")
    return _scaled(hex_richness(facts, aoi, 4, geometry=False))


@query("stored_zonal_richness", o.zonal_richness(CHILD_REGIONS, 4))
def _(spark, sf):
    aoi = cache.cached_aoi(_child_regions(spark, sf), 4)
    facts = sources.open_region(_stored_occurrences(spark, sf), aoi).drop("h0")
    return _scaled(zonal_richness(facts, aoi, 4))


def _bucketed_occurrences(spark, sf):
    """Distinct (taxon, cell) of level 5 in buckets by cell, written once for this run."""
    folder = f"{shared_folder(spark)}/bucketed-{uuid.uuid4().hex}"
    facts = t.occurrences(spark, sf, 5).distinct()
    prepare.write_bucketed(facts, folder, "h5", 16)
    return sources.open_bucketed(spark, folder, "h5", 16)


@query("bucketed_hex_richness", o.hex_richness(OVERLAP, 5))
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 5)
    return _scaled(hex_richness(_bucketed_occurrences(spark, sf), aoi, 5, geometry=False))


@query("bucketed_zonal_richness", o.zonal_richness(OVERLAP, 5))
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 5)
    return _scaled(zonal_richness(_bucketed_occurrences(spark, sf), aoi, 5))


SET_LEVEL, COARSEST_SET = 5, 1


def _stored_sets(spark, sf) -> DataFrame:
    """Taxa of every cell of levels 1 to 5, as their positions in buckets, stored by base cell."""
    source = cache.files_fingerprint(spark, f"{sf}/lineitem.parquet")

    def write(path):
        whole = bitmaps.listed_sets(t.occurrences(spark, sf, SET_LEVEL), SET_LEVEL, COARSEST_SET)
        prepare.write_compact(bitmaps.by_base_cell(whole), path)

    levels = {"level": SET_LEVEL, "coarsest": COARSEST_SET}
    return sources.open_cells(spark, cache.stored_folder(spark, "taxa-lists", [source], levels, write))


@query("zonal_species_sets", o.zonal_richness(OVERLAP, SET_LEVEL, "species"))
def _(spark, sf):
    """Distinct taxa per zone from stored sets: one per block inside a zone."""
    aoi = compact_fill(t.overlap(spark, sf), SET_LEVEL, start=COARSEST_SET)
    sets = _stored_sets(spark, sf)
    return _scaled(bitmaps.zonal_richness(sets, aoi, SET_LEVEL, mode="species", coarsest=COARSEST_SET))


@query("zonal_occupancy_sets", o.zonal_richness(OVERLAP, SET_LEVEL))
def _(spark, sf):
    aoi = compact_fill(t.overlap(spark, sf), SET_LEVEL, start=COARSEST_SET)
    sets = _stored_sets(spark, sf)
    return _scaled(bitmaps.zonal_richness(sets, aoi, SET_LEVEL, coarsest=COARSEST_SET))


@query("hex_richness_sets", o.hex_richness(OVERLAP, 3))
def _(spark, sf):
    """Cells of level 3 from sets of level 5, of two deliveries of records that overlap."""
    facts = t.occurrences(spark, sf, SET_LEVEL)
    old, new = (bitmaps.taxa_sets(facts.where(part), SET_LEVEL) for part in (
        "taxonkey is null or taxonkey % 3 < 2", "taxonkey is null or taxonkey % 3 > 0"
    ))
    sets = bitmaps.roll_up(bitmaps.merge(old, new), SET_LEVEL, 3)
    return _scaled(bitmaps.hex_richness(sets, polyfill(t.overlap(spark, sf), 3), 3))


# -- cache and publishing --------------------------------------------------------------


@query("cache_roundtrip", _aoi_sql(o.sql("COUNTIES"), 4))
def _(spark, sf):
    return cache.cached_aoi(t.counties(spark, sf), 4)


_COUNTED = (
    f"SELECT {o.up('cell', 4, 0)} AS h0, cell AS h4, count(*) AS records FROM ({o.occurrences(4)}) o "
    "WHERE taxonkey IS NOT NULL GROUP BY 1, 2"
)


@query(
    "cached_by_base_cell",
    f"""SELECT h0, CAST(count(*) AS BIGINT) AS cells, CAST(sum(records) AS BIGINT) AS records,
      h0 % 5 = 0 AS computed_again FROM (
      SELECT h0, h4, CASE WHEN h0 % 5 = 0 THEN 2*records ELSE records END AS records FROM ({_COUNTED}) c) s GROUP BY h0""",
)
def _(spark, sf):
    """Records of a fifth of the base cells come twice; the others' files are read as they were."""
    root = _scratch(spark)
    facts = t.occurrences(spark, sf, 4).where("taxonkey is not null")
    facts = prepare.with_parents(facts, 4, [0])
    later = facts.unionByName(facts.where("h0 % 5 = 0"))

    def counted(rows):
        return rows.groupBy("h0", "h4").agg(F.count("*").alias("records"))

    run = F.regexp_extract(F.input_file_name(), "_run=([0-9a-f]+)", 1)
    first = cache.cached_by_part(facts, "records", {"level": 4}, counted, root).withColumn("run", run)
    second = cache.cached_by_part(later, "records", {"level": 4}, counted, root).withColumn("run", run)
    before = first.groupBy("h0").agg(F.min("run").alias("before"))
    now = second.groupBy("h0").agg(
        F.count("*").alias("cells"), F.sum("records").alias("records"), F.min("run").alias("now")
    )
    return now.join(before, "h0").select("h0", "cells", "records", (F.col("now") != F.col("before")).alias("computed_again"))


@query(
    "published_zonal_carbon",
    f"SELECT id, carbon, value, xmin, ymin, xmax, ymax FROM ({o.mean_value(REGIONS, CARBON_LEVEL, 3, 'id')}) s "
    f"JOIN (SELECT id, {EXTENT_SQL} FROM ({REGIONS}) z) e USING (id)",
)
def _(spark, sf):
    zones = t.regions(spark, sf)
    inputs = [cache.files_fingerprint(spark, f"{sf}/events.parquet"), cache.fingerprint(zones)]

    def compute():
        aoi = cache.cached_aoi(zones, 3)
        return rounded_means(
            zonal_carbon(_stored_carbon(spark, sf), aoi, 3, zones=zones), "carbon", "value"
        )

    folder = cache.published(spark, "zonal-carbon", inputs, {"level": 3, "id": "id"}, compute)
    found = features.read_geojson(spark, folder, one_per_line=True)
    given = F.col("properties")
    return with_extent(
        found.select(
            given["id"].cast("int").alias("id"),
            given["carbon"].cast("double").alias("carbon"),
            given["value"].cast("double").alias("value"),
            "geometry",
        ),
        "geometry",
    )


# Amounts in hundredths, as the two engines spell doubles differently.
LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity*100) AS BIGINT) AS quantity,
       CAST(round(l_extendedprice*100) AS BIGINT) AS price, CAST(round(l_discount*100) AS BIGINT) AS discount,
       CAST(round(l_tax*100) AS BIGINT) AS tax, l_returnflag, l_linestatus,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS shipped FROM {lineitem}
"""
_LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber quantity price discount tax "
    "l_returnflag l_linestatus shipped"
).split()
_LINE_TEXT = " || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _LINE_COLUMNS
)


@query(
    "table_fingerprint",
    "SELECT n, sha256(n || ':' || a || ':' || b) AS digest FROM (SELECT count(*) AS n, "
    "sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS b "
    f"FROM (SELECT md5({_LINE_TEXT}) AS d FROM ({t.duck(LINES)}) l) m) s",
)
def _(spark, sf):
    return cache.fingerprint_columns(t.derive(spark, sf, LINES))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}"


@query("geojson_features", _extent_of(o.sql("TRACTS"), "FIPS, COUNTY"))
def _(spark, sf):
    path = _scratch(spark)
    publish.write_geojson(t.tracts(spark, sf).drop("id"), path, "geometry")
    back = features.read_geojson(spark, path, one_per_line=True)
    return with_extent(
        back.select(
            F.col("properties")["FIPS"].alias("FIPS"),
            F.col("properties")["COUNTY"].alias("COUNTY"),
            "geometry",
        ),
        "geometry",
    )


@query("geojson_document", _extent_of(o.sql("TRACTS"), "FIPS, COUNTY"))
def _(spark, sf):
    path = f"{_scratch(spark)}/tracts.geojson"
    publish.write_geojson_document(t.tracts(spark, sf).drop("id"), path, "geometry")
    back = features.read_geojson(spark, path)
    return with_extent(
        back.select(
            F.col("properties")["FIPS"].alias("FIPS"),
            F.col("properties")["COUNTY"].alias("COUNTY"),
            "geometry",
        ),
        "geometry",
    )


DOCUMENTS = """
SELECT s_suppkey AS id, CAST(s_suppkey % 90 AS STRING) AS x FROM {supplier}
"""


@query(
    "geojson_kinds",
    f"""
    SELECT id, 'f1' AS feature_id, 'Point' AS kind, NULL AS parts, NULL AS rings, CAST(id % 90 AS DOUBLE) AS x, 'a' AS name
    FROM ({t.duck(DOCUMENTS)}) d UNION ALL
    SELECT id, 'f2', 'Polygon', 1, 2, NULL, 'b' FROM ({t.duck(DOCUMENTS)}) d UNION ALL
    SELECT id, NULL, 'MultiPolygon', 2, 1, NULL, NULL FROM ({t.duck(DOCUMENTS)}) d
    """,
)
def _(spark, sf):
    ring = "[[0,0],[9,0],[9,9],[0,0]]"
    text = (
        '{"type":"FeatureCollection","features":['
        '{"type":"Feature","id":"f1","properties":{"name":"a"},"geometry":{"type":"Point","coordinates":[%s,1.5]}},'
        '{"type":"Feature","id":"f2","properties":{"name":"b"},"geometry":{"type":"Polygon","coordinates":'
        f"[{ring},[[1,1],[2,1],[2,2],[1,1]]]}}}},"
        '{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":'
        f"[[{ring}],[{ring}]]}}}}]}}"
    )
    documents = t.derive(spark, sf, DOCUMENTS).select("id", F.format_string(text, "x").alias("json"))
    found = features.parse_geojson(documents, "json")
    shape = F.col("geometry")
    return found.select(
        "id",
        "feature_id",
        "kind",
        F.when(shape.isNotNull(), F.size(shape)).alias("parts"),
        F.when(shape.isNotNull(), F.size(shape[0])).alias("rings"),
        F.col("point.x").alias("x"),
        F.col("properties")["name"].alias("name"),
    )


@query(
    "geojson_bare_geometry",
    f"""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'Polygon' WHEN id % 3 = 1 THEN 'Point' END AS kind,
           CASE WHEN id % 3 = 0 THEN 1 END AS parts, CASE WHEN id % 3 = 1 THEN CAST(id % 90 AS DOUBLE) END AS x,
           CASE WHEN id % 3 = 2 THEN 'not GeoJSON' END AS error FROM ({t.duck(DOCUMENTS)}) d
    """,
)
def _(spark, sf):
    texts = F.when(
        F.col("id") % 3 == 0, '{"type":"Polygon","coordinates":[[[0,0],[9,0],[9,9],[0,0]]]}'
    ).when(F.col("id") % 3 == 1, F.format_string('{"type":"Point","coordinates":[%s,1.5]}', "x"))
    documents = t.derive(spark, sf, DOCUMENTS)
    found = features.parse_geojson(
        documents.select("id", texts.otherwise('{"type":"Poly').alias("json")), "json"
    )
    shape = F.col("geometry")
    parts = F.when(shape.isNotNull(), F.size(shape)).alias("parts")
    return found.select("id", "kind", parts, F.col("point.x").alias("x"), "error")


@query(
    "aoi_point_features",
    f"SELECT {o.up('h5', 5, 0)} AS h0, h5, event_id FROM "
    f"(SELECT event_id, {o.cell('lng', 'lat', 5)} AS h5 FROM ({o.sql('CARBON_POINTS')}) p) c",
)
def _(spark, sf):
    place = F.array("lng", "lat")
    document = F.struct(F.lit("Point").alias("type"), place.alias("coordinates"))
    points = t.derive(spark, sf, t.CARBON_POINTS)
    found = features.parse_geojson(points.select("event_id", F.to_json(document).alias("json")), "json")
    return polyfill(found, 5, ["event_id"])


@query("csv_download", SPECIES_SQL)
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    table = species_table(t.occurrences(spark, sf, 3, ranks=True), aoi, 3)
    path = _scratch(spark)
    publish.write_csv(table, path)
    return spark.read.schema(table.schema).option("header", "true").csv(path)


@query("csv_document", SPECIES_SQL)
def _(spark, sf):
    aoi = polyfill(t.overlap(spark, sf), 3)
    table = species_table(t.occurrences(spark, sf, 3, ranks=True), aoi, 3)
    path = f"{_scratch(spark)}/species.csv"
    publish.write_csv_document(table, path)
    return spark.read.schema(table.schema).option("header", "true").csv(path)


@query(
    "public_urls",
    "SELECT page_id, 'https://data.example.org/pages/' || CAST(page_id AS VARCHAR) || '.html' AS url FROM pages",
)
def _(spark, sf):
    path = F.concat(F.lit("s3://pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = t.read(spark, sf, "pages")
    return pages.select(
        "page_id", sources.public_url_column(path, "data.example.org").alias("url")
    )


# -- summaries and styling -----------------------------------------------------------


@query(
    "percentile_filter",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > "
    "(SELECT min(v) FROM (SELECT l_extendedprice AS v, cume_dist() OVER (ORDER BY l_extendedprice) AS c "
    "FROM lineitem) d WHERE c >= 0.9)",
)
def _(spark, sf):
    rows = t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.above_percentile(rows, "l_extendedprice", 0.9)


@query(
    "grouped_percentiles",
    "SELECT l_returnflag, l_linestatus, CAST(share AS DOUBLE) AS share, min(v) AS value, n FROM "
    "(SELECT l_returnflag, l_linestatus, l_extendedprice AS v, "
    "row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, "
    "count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) d, "
    "(VALUES (0.1), (0.5), (0.99)) s(share) WHERE r >= ceil(share * n) GROUP BY ALL",
)
def _(spark, sf):
    rows = t.read(spark, sf, "lineitem")
    return stats.exact_percentiles(rows, "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag", "l_linestatus"])


@query(
    "latency_summary",
    "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 <> 0) AS n_ok, "
    "round(count(*) FILTER (event_id % 7 <> 0)*100.0e0/count(*) + 1e-10, 6) AS success_pct, "
    "round(avg(value) FILTER (event_id % 7 <> 0) + 1e-10, 6) AS mean_seconds, "
    "round(coalesce(stddev_samp(value) FILTER (event_id % 7 <> 0), 0) + 1e-10, 6) AS sd_seconds "
    "FROM events GROUP BY user_id",
)
def _(spark, sf):
    calls = t.read(spark, sf, "events")
    summary = stats.latency_summary(calls, "user_id", F.col("value"), F.col("event_id") % 7 != 0)
    return rounded_means(summary, "success_pct", "mean_seconds", "sd_seconds")


def _recode_sql(column: str, values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {whens} ELSE '{style.DEFAULT_COLOUR}' END"


@query(
    "style_columns",
    f"SELECT row_n, {_recode_sql('Mang_Type', style.MANAGER_COLOURS)} AS manager_colour, "
    f"{_recode_sql('GAP_Sts', style.GAP_STATUS_COLOURS)} AS gap_colour, "
    "'Name: ' || Unit_Nm || '<br>Class: ' || coalesce(FeatClass, '') AS label "
    f"FROM ({o.sql('PROTECTED')}) p",
)
def _(spark, sf):
    return t.protected_areas(spark, sf).select(
        "row_n",
        style.manager_colour(F.col("Mang_Type")).alias("manager_colour"),
        style.gap_colour(F.col("GAP_Sts")).alias("gap_colour"),
        style.label({"Name": F.col("Unit_Nm"), "Class": F.col("FeatClass")}).alias("label"),
    )


def _channel_sql(offset: int) -> str:
    levels = [int(s[offset : offset + 2], 16) for s in style.VIRIDIS]
    table = "[" + ", ".join(f"{v}e0" for v in levels) + "]"
    return (
        f"CAST(floor({table}[seg + 1] + ({table}[seg + 2] - {table}[seg + 1])*(pos - seg) + 0.5e0) AS INT)"
    )


@query(
    "style_ramp",
    f"SELECT l_orderkey, l_linenumber, printf('#%02x%02x%02x', {_channel_sql(1)}, {_channel_sql(3)}, {_channel_sql(5)}) AS colour, "
    "round(v*10000, 6) AS height FROM (SELECT *, CAST(least(floor(pos), 5) AS INT) AS seg FROM "
    "(SELECT l_orderkey, l_linenumber, l_quantity/50 AS v, l_quantity/50*6 AS pos FROM lineitem) a) b",
)
def _(spark, sf):
    value = F.col("l_quantity") / 50
    return t.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        style.ramp_colour(value).alias("colour"),
        F.round(style.extrusion_height(value), 6).alias("height"),
    )
