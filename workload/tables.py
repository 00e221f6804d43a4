"""Stand-ins for the engine's inputs, derived from the given tables.

The SQL runs unchanged in Spark and DuckDB; ``{name}`` marks a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellzonal.functions import geometry as geo, grid
from cellzonal.operators.taxa import RANKS

GIVEN = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

OCCURRENCES = """
SELECT CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE l_partkey END AS taxonkey,
       CAST((l_orderkey*7919 + l_linenumber*104729) % 36000 AS DOUBLE)/100 - 180 AS lng,
       CAST((l_orderkey*6101 + l_suppkey*3571) % 18000 AS DOUBLE)/100 - 90 AS lat
FROM {lineitem}
"""

TAXA = """
SELECT kingdom, phylum, class, ordr, family,
       family || '/' || CAST(taxonkey % 3 AS STRING) AS genus,
       p_name || ' ' || CAST(taxonkey AS STRING) AS species, taxonkey
FROM (SELECT *, ordr || '/' || split_part(p_name, ' ', 2) AS family
FROM (SELECT *, CASE WHEN taxonkey % 17 = 0 THEN NULL
                     ELSE class || '/' || split_part(p_name, ' ', 1) END AS ordr
FROM (SELECT p_partkey AS taxonkey, p_name, p_type AS kingdom, p_type || '/' || p_brand AS phylum,
             p_type || '/' || p_brand || '/' || CAST(p_size AS STRING) AS class
      FROM {part}) a) b) c
"""

CARBON_POINTS = """
SELECT event_id, CAST((event_id*7907) % 36000 AS DOUBLE)/100 - 180 AS lng,
       CAST((event_id*6089) % 18000 AS DOUBLE)/100 - 90 AS lat,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS Z
FROM {events}
"""

RANGE_POINTS = """
SELECT o_custkey AS taxon_id,
       CAST((o_orderkey*7919) % 36000 AS DOUBLE)/100 - 180 AS lng,
       CAST((o_orderkey*6101) % 18000 AS DOUBLE)/100 - 90 AS lat
FROM {orders}
"""

# Range taxa have ranks of their own, so that both tables may be filtered.
RANGE_TAXA = """
SELECT c_custkey AS id, c_mktsegment AS kingdom,
       c_mktsegment || '/' || CAST(c_nationkey AS STRING) AS phylum
FROM {customer}
"""


def _corners(x: str, y: str, scale: int) -> str:
    """Three corners of a triangle; offsets keep cell centres off its edges."""
    offsets = {"a": ("0.13e0", "0.17e0"), "m": ("71.31e0", "0.29e0"), "c": ("33.7e0", "35.1e0")}
    return ", ".join(
        f"{x} + {dx}/{scale} AS {p}x, {y} + {dy}/{scale} AS {p}y" for p, (dx, dy) in offsets.items()
    )


def _nation_origin(nation: str) -> tuple[str, str]:
    return (
        f"CAST(-180 + 72*({nation} % 5) AS DOUBLE)",
        f"(CAST(floor({nation} / 5) AS DOUBLE)*36 - 90)",
    )


def _spread(nation: str, key: str, scale: int) -> str:
    x, y = _nation_origin(nation)
    return _corners(
        f"({x} + CAST(7*({key} % 9) AS DOUBLE))", f"({y} + CAST(3*({key} % 7) AS DOUBLE))", scale
    )


# Corner tables: one row per triangle, ``part`` numbers the triangles of a zone.
def _country_part(part: int) -> str:
    x, y = f"{180 * (part - 1)}", "CAST(-90 + 36*r_regionkey AS DOUBLE)"
    return f"""
SELECT 'C' || CAST(r_regionkey AS STRING) AS id, 'C' || CAST(r_regionkey AS STRING) AS country,
       r_name AS "primary", {part} AS part,
       {x} + 0.13e0*2 AS ax, {y} + 0.17e0 AS ay, {x} + 71.31e0*2 AS mx, {y} + 0.29e0 AS my,
       {x} + 33.7e0*2 AS cx, {y} + 35.1e0 AS cy
FROM {{region}}
"""


COUNTRY_WEST = _country_part(0)
COUNTRIES = COUNTRY_WEST + " UNION ALL " + _country_part(1)

REGIONS = (
    "SELECT n_nationkey AS id, 'N' || CAST(n_nationkey AS STRING) AS region, "
    "'C' || CAST(n_regionkey AS STRING) AS country, n_name AS \"primary\", 0 AS part, "
    + _corners(*_nation_origin("n_nationkey"), 1)
    + " FROM {nation}"
)

SHIFTED_REGIONS = (
    "SELECT n_nationkey + 100 AS id, 0 AS part, "
    + _corners(
        f"({_nation_origin('n_nationkey')[0]} + 5.5e0)", _nation_origin("n_nationkey")[1], 1
    )
    + " FROM {nation}"
)

COUNTIES = (
    "SELECT s_suppkey AS id, 'N' || CAST(s_nationkey AS STRING) AS region, s_name AS \"primary\", "
    "0 AS part, " + _spread("s_nationkey", "s_suppkey", 8) + " FROM {supplier}"
)

# Counties pushed across the date line, by amounts that keep cell centres off their edges.
DATE_LINE = (
    "SELECT id, part, ax + push AS ax, ay, mx + push AS mx, my, cx + push AS cx, cy "
    f"FROM (SELECT *, 176.03e0 + CAST(id % 4 AS DOUBLE) - ax AS push FROM ({COUNTIES}) c) p"
)

# Triangles around a pole, one a supplier, told by the height of their corners.
POLES = (
    "SELECT s_suppkey AS id, CAST(s_suppkey % 17 AS DOUBLE) + 0.13e0 AS turn, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 1e0 ELSE -1e0 END AS side, "
    "51.17e0 + CAST(s_suppkey % 23 AS DOUBLE) AS height FROM {supplier}"
)

TRACTS = (
    "SELECT 'F' || CAST(c_custkey AS STRING) AS FIPS, 'F' || CAST(c_custkey AS STRING) AS id, "
    "CASE WHEN c_custkey % 2 = 0 THEN low_county ELSE high_county END AS COUNTY, 0 AS part, "
    + _spread("c_nationkey", "c_custkey", 64)
    + " FROM {customer} JOIN (SELECT s_nationkey, min(s_name) AS low_county, max(s_name) AS high_county"
    " FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = c_nationkey"
)

# Manager types of protected areas.
MANAGER_TYPES = ("JNT", "TERR", "STAT", "FED", "UNK", "LOC", "PVT", "DIST", "TRIB", "NGO")
PROTECTED = (
    "SELECT s_suppkey AS row_n, s_name AS Unit_Nm, CAST(1 + s_suppkey % 4 AS STRING) AS GAP_Sts, "
    "CASE CAST(s_suppkey % 11 AS INT) "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(MANAGER_TYPES))
    + " ELSE 'OTHER' END AS Mang_Type, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'Fee' END AS FeatClass"
    " FROM {supplier}"
)

CORNERS = ("ax", "ay", "mx", "my", "cx", "cy")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run stand-in SQL on the Parquet files of one scale."""
    text = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf}/{m.group(1)}.parquet`", sql)
    return spark.sql(text.replace('"', "`"))


def duck(sql: str) -> str:
    """The same SQL for DuckDB, where the given tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


# -- facts ------------------------------------------------------------------------


def taxa(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, TAXA).withColumnRenamed("ordr", "order")


def occurrence_points(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, OCCURRENCES)


def occurrences(spark: SparkSession, sf: str, level: int, ranks: bool = False) -> DataFrame:
    """Occurrence facts with one cell column; ``ranks`` adds the taxon columns."""
    points = occurrence_points(spark, sf)
    facts = points.select(
        "taxonkey", grid.cell_at("lng", "lat", level).alias(f"h{level}")
    )
    return facts.join(taxa(spark, sf), "taxonkey", "left") if ranks else facts


def carbon_raw(spark: SparkSession, sf: str, level: int) -> DataFrame:
    points = derive(spark, sf, CARBON_POINTS)
    cells = points.select(grid.cell_at("lng", "lat", level).alias("h_zoom"), "Z")
    return cells.select(grid.parent("h_zoom", level, 0).alias("h0"), "h_zoom", "Z")


def range_cells(spark: SparkSession, sf: str, level: int = 2) -> DataFrame:
    """Distinct (taxon, cell) at one level with all coarser cells."""
    points = derive(spark, sf, RANGE_POINTS)
    cell = f"h{level}"
    rows = points.select("taxon_id", grid.cell_at("lng", "lat", level).alias(cell)).distinct()
    return rows.withColumns({f"h{k}": grid.parent(cell, level, k) for k in range(level)})


def range_taxa(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, RANGE_TAXA)


# -- zones ------------------------------------------------------------------------


def triangle(shift: float = 0.0) -> Column:
    """One part: the closed triangle through the corner columns."""
    points = ", ".join(f"named_struct('x', {p}x + {shift}D, 'y', {p}y)" for p in "amca")
    return F.expr(f"array(array({points}))")


def _zones(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    corners = derive(spark, sf, sql)
    rest = [c for c in corners.columns if c not in (*CORNERS, "part")]
    return corners.select(*rest, F.array(triangle()).alias("geometry"))


def countries(spark: SparkSession, sf: str) -> DataFrame:
    west = derive(spark, sf, COUNTRY_WEST)
    return west.select(
        "id", "country", "primary", F.array(triangle(), triangle(180.0)).alias("geometry")
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return _zones(spark, sf, REGIONS)


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and copies of them shifted east, under new ids."""
    return regions(spark, sf).select("id", "geometry").unionByName(_zones(spark, sf, SHIFTED_REGIONS))


def counties(spark: SparkSession, sf: str) -> DataFrame:
    return _zones(spark, sf, COUNTIES)


def date_line(spark: SparkSession, sf: str) -> DataFrame:
    """Zones across the date line, all longitudes within -180 .. 180."""
    return _zones(spark, sf, DATE_LINE).withColumn("geometry", geo.wrapped(F.col("geometry")))


def poles(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of level edges around a pole, a third of the way round each."""
    corners = ", ".join(f"named_struct('x', {k}D + turn, 'y', side * height)" for k in (-150, -30, 90, -150))
    return derive(spark, sf, POLES).select("id", F.expr(f"array(array(array({corners})))").alias("geometry"))


def tracts(spark: SparkSession, sf: str) -> DataFrame:
    return _zones(spark, sf, TRACTS)


def protected_areas(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, PROTECTED)


def layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "country_layer": countries(spark, sf),
        "region_layer": regions(spark, sf),
        "county_layer": counties(spark, sf),
        "tract_layer": tracts(spark, sf),
        "pad_layer": protected_areas(spark, sf),
    }
