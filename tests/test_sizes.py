"""Joins with the cells of a small table of zones: no plan sends them to the driver unmeasured."""

import re

import pytest
from pyspark.sql import functions as F

from cellzonal.functions import geometry as geo, grid
from cellzonal.operators import joins
from cellzonal.operators.exact import spatial_join
from cellzonal.operators.polyfill import compact_fill, polyfill, run_area
from cellzonal.plans.richness import zonal_richness
from cellzonal.session import unsized
from tests.helpers import inside, plan, rows, square, square_zone, zones
from workload.queries import QUERIES


def world(spark):
    """Ten large zones of which the planner knows that they are few."""
    corners = ((-170, -80), (-150, -80), (-150, 80), (-170, 80), (-170, -80))
    ring = ", ".join(f"named_struct('x', {x}D + 30 * id, 'y', {y}D)" for x, y in corners)
    return spark.range(10).selectExpr("id", f"array(array(array({ring}))) as geometry")


@pytest.fixture
def static(spark):
    """Plans as first written, without run-time changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def sightings(spark, n):
    spots = spark.range(n).selectExpr(
        "id as taxonkey", "(id * 7919) % 36000 / 100 - 180 as x", "(id * 6101) % 18000 / 100 - 90 as y"
    )
    return spots.select("taxonkey", grid.cell_at("x", "y", 5).alias("h5"))


def broadcasts(df):
    """Joins that are planned with a broadcast, apart from the bounded cover of an area."""
    return [line for line in plan(df).splitlines() if re.search("BroadcastHashJoin|NestedLoop", line) and "_cover" not in line]


def test_runs_of_few_zones_are_not_broadcast_unmeasured(static):
    facts = sightings(static, 10**8)
    assert broadcasts(joins.cell_join(facts, run_area(world(static), 5), 5)) == []


def test_small_sides_are_broadcast_once_measured(spark):
    """The rows stay the same, and so does what a run-time size allows."""
    facts = sightings(spark, 3000)
    areas = polyfill(world(spark), 5), run_area(world(spark), 5)
    found = [joins.cell_join(facts, aoi, 5).select("taxonkey", "h5", "id") for aoi in areas]
    assert rows(found[0]) == rows(found[1]) and found[0].count() > 1000
    few = spark.range(5).withColumnRenamed("id", "taxonkey")
    met = facts.repartition(4).groupBy("taxonkey").agg(F.count("*").alias("n")).join(unsized(few), "taxonkey")
    assert met.count() == 5
    met.collect()
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()


def test_unsized_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x")], "`a b` long, c string")
    assert unsized(df).schema == df.schema and sorted(map(str, unsized(df).collect())) == sorted(map(str, df.collect()))


def big_points(spark):
    return spark.range(10**8).selectExpr("id as n", "(id % 36000) / 100 - 180 as lng", "(id % 17999) / 100 - 90 as lat")


def test_exact_join_sends_no_buckets_to_the_driver_unmeasured(static):
    assert broadcasts(spatial_join(big_points(static), world(static))) == []


def test_exact_join_tests_a_part_of_many_zones_once(spark):
    """Zones of the same part, of several ones, of overlapping ones and listed twice; points as named inside."""
    box, far = [square(0.0, 0.0, 10.0, 10.0)], [square(100.0, 0.0, 110.0, 10.0)]
    lap, hole = [square(5.0, 5.0, 15.0, 15.0)], [square(0.0, 0.0, 10.0, 10.0), square(2.0, 2.0, 4.0, 4.0)]
    shapes = [(f"b{i}", [box]) for i in range(5)] + [("two", [box, far]), ("laps", [box, lap]), ("hole", [hole])]
    shapes += [("twice", [box]), ("twice", [box]), ("parts", [box]), ("parts", [lap]), ("reversed", [[box[0][::-1]]])]
    places = [(7.0, 7.0), (7.0, 7.0), (3.0, 3.0), (12.0, 12.0), (105.0, 5.0), (50.0, 50.0)]
    points = spark.createDataFrame(
        [(i, *p, 1) for i, p in enumerate(places)], "_polygon long, lng double, lat double, _mark int"
    )
    found = spatial_join(points, zones(spark, shapes), level=4)
    assert found.columns == ["_polygon", "lng", "lat", "_mark", "id"]
    held = {(i, name) for i, p in enumerate(places) for name, parts in shapes for part in parts if inside(part, *p)}
    assert sorted((r["_polygon"], r["id"]) for r in found.collect()) == sorted(held)
    assert {tuple(r) for r in spatial_join(points, zones(spark, shapes), keep=(), level=4).collect()} == {
        (i, *p, 1) for i, p in enumerate(places[:5])
    }


def test_exact_join_across_the_date_line_sends_nothing_unmeasured(static):
    turned = world(static).withColumn("geometry", F.transform("geometry", lambda p: F.transform(p, lambda r: F.transform(
        r, lambda c: F.struct((c["x"] + 165).alias("x"), c["y"].alias("y"))))))
    zones = turned.withColumn("geometry", geo.wrapped(F.col("geometry")))
    assert broadcasts(spatial_join(big_points(static), zones)) == []


def test_points_meet_the_cells_of_their_own_zone(spark):
    """An area of any kind is met by cell and id; rows without a match stay in an outer join."""
    shapes = zones(spark, [("a", square_zone(0, 0, 20, 20)), ("b", square_zone(10, 10, 30, 30))])
    spots = [(x + 0.5, y + 0.5) for x in range(-2, 32, 3) for y in range(-2, 32, 3)]
    found = spark.createDataFrame([(x, y, i) for x, y in spots for i in ("a", "b", "c", None)], "x double, y double, id string")
    found = found.select("x", "y", "id", grid.cell_at("x", "y", 4).alias("h4"))
    plain = {(r["h4"], r["id"]) for r in polyfill(shapes, 4).collect()}
    wanted = sorted(((r["x"], r["y"], r["id"], True if (r["h4"], r["id"]) in plain else None) for r in found.collect()), key=repr)
    for area in (polyfill(shapes, 4).drop("h0"), run_area(shapes, 4)):
        met = joins.meet(found, area.withColumn("both", F.lit(True)), 4, ["both"], how="left", on=["id"])
        assert rows(met, "x", "y", "id", "both") == wanted
    inner = joins.meet(found, compact_fill(shapes, 4).withColumn("both", F.lit(True)), 4, ["both"], on=["id"])
    assert rows(inner, "x", "y", "id", "both") == [r for r in wanted if r[3]]


def test_exact_against_cells_broadcasts_no_cells(static, sf):
    outer = [line for line in plan(QUERIES["exact_against_cells"](static, sf)).splitlines() if "LeftOuter" in line]
    assert outer and all("SortMergeJoin" in line for line in outer)


def test_compact_areas_are_made_and_met_without_unmeasured_broadcasts(static):
    aoi = compact_fill(world(static), 5, start=3)
    assert broadcasts(aoi) == []
    met = zonal_richness(sightings(static, 10**8), aoi, 5, "id", taxon="taxonkey")
    assert [line for line in broadcasts(met) if "_key" in line] == []


def test_plain_cells_of_few_zones_are_not_broadcast_unmeasured(static):
    facts = sightings(static, 10**8)
    assert broadcasts(joins.cell_join(facts, polyfill(world(static), 5).drop("h0"), 5)) == []
