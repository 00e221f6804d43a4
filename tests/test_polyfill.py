import random

import pytest
from pyspark.sql import functions as F

from cellzonal.functions import geometry as geo, grid
from cellzonal.operators.exact import spatial_join
from cellzonal.operators.grids import DictionaryGrid
from cellzonal.operators.polyfill import (
    compact_fill,
    dump_parts,
    polyfill,
    polyfill_retrying,
    run_area,
    touched_cells,
)
from cellzonal.plans.richness import zonal_richness
from tests.helpers import brute_cells, inside, pack, rows, square, square_zone, zones


def star(rng, cx, cy, r, corners):
    """A star-shaped ring with irregular corners."""
    import math

    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [
        (cx + rng.uniform(0.3, 1) * r * math.cos(a), cy + rng.uniform(0.3, 1) * r * math.sin(a))
        for a in angles
    ]
    return ring + [ring[0]]


def filled(df, level, key="id"):
    got = {}
    for row in polyfill(df, level, [key]).collect():
        got.setdefault(row[key], []).append(row[f"h{level}"])
    return got


def test_equals_point_test_on_random_shapes(spark):
    rng = random.Random(7)
    shapes = []
    for i in range(12):
        cx, cy, r = rng.uniform(-150, 150), rng.uniform(-60, 60), rng.uniform(5, 40)
        part = [star(rng, cx, cy, r, rng.randint(3, 14))]
        if i % 3 == 0:
            part.append(star(rng, cx, cy, r / 6, 5))
        parts = [part]
        if i % 4 == 0:
            parts.append([star(rng, -cx, -cy, r / 2, 6)])
        shapes.append((f"z{i}", parts))
    got = filled(zones(spark, shapes), 2)
    for name, parts in shapes:
        wanted = brute_cells(parts, 2)
        assert sorted(got.get(name, [])) == sorted(wanted), name


def test_hole_and_parts(spark):
    outer, hole = square(-60.1, -40.1, 60.1, 40.1), square(-20.2, -20.2, 20.2, 20.2)
    df = zones(spark, [("a", [[outer, hole]]), ("b", [[outer], [square(80.3, 0.3, 99.9, 20.1)]])])
    got = filled(df, 2)
    assert set(got["a"]) == brute_cells([[outer, hole]], 2)
    assert set(got["b"]) == brute_cells([[outer], [square(80.3, 0.3, 99.9, 20.1)]], 2)
    assert rows(dump_parts(df), "id", "part") == [("a", 0), ("b", 0), ("b", 1)]


def test_overlapping_parts_and_repeated_zones_give_each_cell_once(spark):
    a, b = square(0.1, 0.1, 30.2, 30.2), square(10.1, 10.1, 50.2, 50.2)
    parts = [[a], [b], [square(11.0, 11.0, 20.0, 20.0)]]
    once = zones(spark, [("z", parts)])
    twice = once.unionByName(once).unionByName(zones(spark, [("z", [[a]])]))
    wanted = sorted(brute_cells(parts, 3))
    assert sorted(filled(once, 3)["z"]) == wanted
    assert sorted(filled(twice, 3)["z"]) == wanted


def test_neighbours_share_no_cell(spark):
    df = zones(spark, [(f"{i}", square_zone(i * 7.3, -10.7, (i + 1) * 7.3, 21.9)) for i in range(6)])
    cells = polyfill(df, 4)
    assert cells.count() == cells.select("h4").distinct().count()
    whole = zones(spark, [("w", square_zone(0, -10.7, 6 * 7.3, 21.9))])
    assert rows(cells, "h4") == rows(polyfill(whole, 4), "h4")


def test_whole_world_and_beyond(spark):
    df = zones(spark, [("w", square_zone(-400, -200, 400, 200))])
    assert polyfill(df, 2).count() == grid.cell_count(2)


def test_level_zero_has_one_cell_column(spark):
    df = zones(spark, [("w", square_zone(-180, -90, 180, 90))])
    cells = polyfill(df, 0)
    assert cells.columns == ["h0", "id"] and cells.count() == 72


def test_columns_and_base_cell(spark):
    df = zones(spark, [("z", square_zone(1, 1, 40, 40))]).withColumn("name", F.lit("n"))
    cells = polyfill(df, 3, ["id", "name"])
    assert cells.columns == ["h0", "h3", "id", "name"]
    assert cells.where(grid.parent("h3", 3, 0) != F.col("h0")).count() == 0


def test_geom_is_another_name_for_geometry(spark):
    df = zones(spark, [("z", square_zone(1, 1, 40, 40))])
    assert rows(polyfill(df.withColumnRenamed("geometry", "geom"), 2)) == rows(polyfill(df, 2))
    with pytest.raises(ValueError):
        polyfill(df.drop("geometry"), 2)


def test_missing_id_column_is_an_error(spark):
    with pytest.raises(ValueError, match="FIPS"):
        polyfill(zones(spark, [("z", square_zone(1, 1, 40, 40))]), 2, ["FIPS"])


def test_zone_smaller_than_a_cell_is_empty_unless_retried(spark):
    df = zones(spark, [("small", square_zone(0.1, 0.1, 1.2, 1.2)), ("big", square_zone(0, 0, 60, 30))])
    assert set(filled(df, 1)) == {"big"}
    tried = polyfill_retrying(df, 1, 4)
    levels = {(r["id"], r["level"]) for r in tried.select("id", "level").distinct().collect()}
    assert levels == {("big", 1), ("small", 3)}


def test_null_and_empty_geometry_have_no_cells(spark):
    df = zones(spark, [("n", None), ("e", []), ("z", square_zone(0.1, 0.1, 9.9, 9.9))])
    assert set(filled(df, 2)) == {"z"}


def test_touched_cells_cover_every_cell_an_outline_meets(spark):
    ring = [(3.0, 4.0), (55.5, 21.0), (20.0, 47.5), (3.0, 4.0)]
    df = zones(spark, [("z", [[ring]])])
    touched = {r[0] for r in touched_cells(df, 3, ["id"]).select("h3").collect()}
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        for i in range(2001):
            f = i / 2000
            x, y = x1 + f * (x2 - x1), y1 + f * (y2 - y1)
            assert pack(3, int((x + 180) * 0.9), int((y + 90) * 0.9)) in touched
    assert len(touched) < 400


def test_dictionary_grid_equals_point_test(spark):
    rng = random.Random(3)
    centres = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(4000)]
    shapes = [
        (f"z{i}", [[star(rng, rng.uniform(-120, 120), rng.uniform(-50, 50), 35, 9)]]) for i in range(6)
    ]
    table = spark.createDataFrame(centres, "cell long, lng double, lat double")
    df = zones(spark, shapes)
    cells = DictionaryGrid(table, bucket_level=2).polyfill(df.unionByName(df.limit(1)), 9, ["id"])
    wanted = sorted(
        (c, name) for c, x, y in centres for name, parts in shapes if inside(parts[0], x, y)
    )
    assert rows(cells, "h9", "id") == sorted(wanted, key=repr)


def test_contains_matches_plain_python(spark):
    part = [square(0.0, 0.0, 10.0, 10.0), square(4.0, 4.0, 6.0, 6.0)]
    df = zones(spark, [("z", [part])])
    asked = [(1.0, 1.0), (5.0, 5.0), (11.0, 1.0), (9.9, 0.1)]
    points = spark.createDataFrame(asked, "x double, y double").withColumn("id", F.lit("z"))
    got = points.join(df, "id").select("x", "y", geo.contains("geometry", "x", "y").alias("in"))
    assert {(r["x"], r["y"]): r["in"] for r in got.collect()} == {
        p: inside(part, *p) for p in asked
    }


@pytest.mark.parametrize("start,step,level", [(1, 1, 4), (2, 2, 4), (4, 2, 5), (0, 3, 3), (4, 2, 3)])
def test_compact_fill_covers_the_same_cells(spark, start, step, level):
    rng = random.Random(level)
    shapes = [
        (f"z{i}", [[star(rng, rng.uniform(-120, 120), rng.uniform(-50, 50), 30, 8)]]) for i in range(5)
    ]
    outer, hole = square(-60.1, -40.1, 60.1, 40.1), square(-20.2, -20.2, 20.2, 20.2)
    shapes += [("hole", [[outer, hole]]), ("two", [[outer], [square(50.3, 0.3, 99.9, 20.1)]])]
    df = zones(spark, shapes)
    compact = compact_fill(df, level, ["id"], start, step).collect()
    got = []
    for row in compact:
        own, y, x = row["cell"] >> 56, (row["cell"] >> 28) & (2**28 - 1), row["cell"] & (2**28 - 1)
        d = 3 ** (level - own)
        got += [(pack(level, x * d + i, y * d + j), row["id"]) for i in range(d) for j in range(d)]
    wanted = rows(polyfill(df, level), f"h{level}", "id")
    assert sorted(got, key=repr) == wanted
    assert level <= start or len(compact) < len(wanted)


def test_points_of_features_give_the_cell_that_holds_them(spark):
    zones = spark.sql(
        "select id, cast(null as " + geo.GEOMETRY_TYPE + ") as geometry, named_struct('x', x, 'y', y) as point "
        "from values (1, 1D, 1D), (1, 1.1D, 1.1D), (2, 100D, -20D), (3, null, null) as t(id, x, y)"
    ).withColumn("point", F.when(F.col("point.x").isNotNull(), F.col("point")))
    wanted = {
        (r["c"], r["id"])
        for r in zones.where("point is not null").select(grid.cell_at("point.x", "point.y", 5).alias("c"), "id").collect()
    }
    plain = polyfill(zones, 5).collect()
    assert {(r["h5"], r["id"]) for r in plain} == wanted and len(plain) == len(wanted)
    assert {(r["cell"], r["id"]) for r in compact_fill(zones, 5).collect()} == wanted
    retried = polyfill_retrying(zones, 5, 6).collect()
    assert {(r["cell"], r["id"]) for r in retried} == wanted


def test_joins_meet_blocks_of_any_level(spark):
    """A compact area from level 0 on gives the rows of the plain one, points' cells included."""
    df = zones(spark, [("z", square_zone(-61.0, -31.0, 61.0, 31.0)), ("s", square_zone(3.1, 4.1, 9.3, 8.2))])
    df = df.withColumn("point", F.expr("named_struct('x', if(id = 's', 100.5D, 5.5D), 'y', 5.5D)"))
    area = compact_fill(df, 6, start=0, step=3)
    assert {r[0] for r in area.selectExpr("shiftright(cell, 56)").distinct().collect()} >= {0, 3, 6}
    spots = spark.range(4000).selectExpr(
        "id as taxonkey", "(id * 7919) % 36000 / 100 - 180 as x", "(id * 6101) % 18000 / 100 - 90 as y"
    )
    facts = spots.select("taxonkey", grid.cell_at("x", "y", 6).alias("h6"))
    facts = facts.unionByName(facts.limit(1).select("taxonkey", grid.cell_at("100.5D", "5.5D", 6).alias("h6")))
    for mode in ("occupancy", "species"):
        got = zonal_richness(facts, area, 6, mode=mode).select("id", "n").collect()
        wanted = zonal_richness(facts, polyfill(df, 6), 6, mode=mode).select("id", "n").collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in wanted} and len(got) == 2


@pytest.mark.parametrize("level", [0, 2, 6])
def test_runs_hold_the_cells_of_the_fill(spark, level):
    rng = random.Random(level)
    shapes = [
        (f"z{i}", [[star(rng, rng.uniform(-120, 120), rng.uniform(-50, 50), 30, 8)]]) for i in range(4)
    ]
    shapes += [("two", [[square(0.0, 0.0, 70.0, 9.0)], [square(40.0, 4.0, 90.0, 20.0)]]), ("n", None)]
    df = zones(spark, shapes)
    df = df.withColumn("point", F.expr("if(id = 'two', named_struct('x', 150.5D, 'y', 5.5D), null)"))
    got = [
        (pack(level, x, r[f"r{level}"]), r["id"])
        for r in run_area(df, level).collect()
        for x in range(r["x0"], r["x1"] + 1)
    ]
    assert sorted(got, key=repr) == rows(polyfill(df, level), f"h{level}", "id")


# -- exact points in polygons ------------------------------------------------------------


def exact(spark, places, shapes, level):
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "n long, lng double, lat double")
    found = spatial_join(points, zones(spark, shapes), level=level)
    return sorted((r["n"], r["id"]) for r in found.collect())


def holds(parts, x, y):
    return any(inside(part, x, y) for part in parts)


@pytest.mark.parametrize("level", [0, 2, 4])
def test_exact_join_equals_a_test_of_every_edge(spark, level):
    rng = random.Random(level)
    shapes = [
        (f"z{i}", [[star(rng, rng.uniform(-150, 150), rng.uniform(-60, 60), 25, 11)]]) for i in range(8)
    ]
    outer, hole = square(-60.0, -30.0, 60.0, 30.0), square(-30.0, -20.0, 20.2, 20.2)
    shapes += [("hole", [[outer, hole]]), ("two", [[outer], [square(50.0, 0.0, 99.9, 20.0)]])]
    shapes += [("small", [[star(rng, 10.0, 10.0, 0.01, 7)]]), ("edge", [[square(170.0, 80.0, 180.0, 90.0)]])]
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(1500)]
    places += [(10 + rng.uniform(-0.01, 0.01), 10 + rng.uniform(-0.01, 0.01)) for _ in range(100)]
    # On corners of buckets, on vertices, on outlines, and at the ends of the world.
    width = 30 / 3**level
    places += [(rng.randrange(-6, 6) * width, rng.randrange(-3, 3) * width) for _ in range(100)]
    places += [p for _, parts in shapes for part in parts for ring in part for p in ring]
    places += [(x, y) for x in (-60.0, 60.0, -30.0, 20.2, 5.0) for y in (-30.0, 30.0, 20.2, -20.0, 1.0)]
    places += [(180.0, 85.0), (-180.0, 85.0), (175.0, 90.0), (0.0, -90.0), (185.0, 85.0)]
    got = exact(spark, places, shapes, level)
    wanted = sorted((i, name) for i, p in enumerate(places) for name, parts in shapes if holds(parts, *p))
    assert got == wanted and len(got) > 200


def test_exact_join_of_odd_rows(spark):
    box = [[square(0.0, 0.0, 10.0, 10.0)]]
    shapes = [("a", box), ("a", box), ("b", [[square(0.0, 0.0, 5.0, 5.0)], [square(4.0, 4.0, 8.0, 8.0)]])]
    shapes += [("n", None), ("e", []), (None, box)]
    places = [(4.5, 4.5), (4.5, 4.5), (7.0, 7.0), (None, 1.0), (float("nan"), 1.0), (50.0, 50.0)]
    got = exact(spark, places, shapes, 3)
    assert got == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]
    clash = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lng double, lat double")
    with pytest.raises(ValueError, match="rename"):
        spatial_join(clash, zones(spark, shapes))


def test_no_shape_is_shuffled_by_the_exact_join(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "n long, lng double, lat double")
    text = spatial_join(points, zones(spark, [("a", [[square(0.0, 0.0, 9.0, 9.0)]])]))
    text = text._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in text.splitlines() if "Join " in line or "Aggregate" in line or "Window" in line]
    assert below and not any("geometry" in line or "rings" in line for line in below)


def around(parts, turns):
    return [[[(x + 360 * turns, y) for x, y in ring] for ring in part] for part in parts]


def across(parts):
    """Longitudes beyond 180 or -180 given on the other side of the map."""
    return [[[((x + 180) % 360 - 180 if abs(x) > 180 else x, y) for x, y in ring] for ring in part] for part in parts]


def date_line_shapes():
    rng = random.Random(31)
    shapes = []
    for i in range(8):
        part = [star(rng, rng.choice([-178.3, 179.1]), rng.uniform(-50, 50), rng.uniform(8, 30), rng.randint(3, 40))]
        if i % 2:
            part.append(star(rng, part[0][0][0], part[0][0][1], 3, 6))
        shapes.append((f"d{i}", [part, [star(rng, 20.0, 10.0, 8, 5)]] if i % 3 == 0 else [part]))
    # A corner on the line itself, from either side.
    shapes.append(("corner", [[[(171.3, 3.1), (180.0, -7.7), (188.9, 4.3), (180.0, 12.9), (171.3, 3.1)]]]))
    return shapes


def date_line_cells(parts, level):
    return {c for turns in (-1, 0, 1) for c in brute_cells(around(parts, turns), level)}


def test_zones_across_the_date_line(spark):
    shapes = date_line_shapes()
    got = filled(zones(spark, [(name, across(parts)) for name, parts in shapes]), 3)
    for name, parts in shapes:
        assert sorted(got.get(name, [])) == sorted(date_line_cells(parts, 3)), name


def test_wrapped_brings_longitudes_back(spark):
    shapes = date_line_shapes()
    given = zones(spark, shapes).withColumn("geometry", geo.wrapped(F.col("geometry")))
    got = filled(given, 3)
    for name, parts in shapes:
        assert sorted(got.get(name, [])) == sorted(date_line_cells(parts, 3)), name


def test_date_line_areas_of_every_kind_are_the_same(spark):
    shapes = [(name, across(parts)) for name, parts in date_line_shapes()]
    df = zones(spark, shapes)
    plain = rows(polyfill(df, 5).select("h5", "id"))
    runs = run_area(df, 5).selectExpr("id", f"explode(transform(sequence(x0, x1), x -> {grid.pack_sql(5, 'x', 'r5')})) as h5")
    assert rows(runs.select("h5", "id")) == plain
    blocks = compact_fill(df, 5, start=0)
    assert blocks.where("shiftright(cell, 56) < 5").count() > 0
    size = F.expr("cast(pow(9, 5 - shiftright(cell, 56)) as bigint)")
    counted = blocks.groupBy("id").agg(F.sum(size).alias("n"))
    assert rows(counted) == rows(polyfill(df, 5).groupBy("id").agg(F.count("*").alias("n")))


def test_exact_points_across_the_date_line(spark):
    shapes = date_line_shapes()
    rng = random.Random(5)
    places = [(rng.choice([-1, 1]) * rng.uniform(140, 180), rng.uniform(-80, 80)) for _ in range(1500)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "n int, lng double, lat double")
    got = set(map(tuple, spatial_join(points, zones(spark, [(n, across(p)) for n, p in shapes])).select("n", "id").collect()))
    wanted = {
        (i, name)
        for i, (x, y) in enumerate(places)
        for name, parts in shapes
        if any(inside(part, x + turn, y) for part in parts for turn in (-360, 0, 360))
    }
    assert got == wanted


def test_rings_around_a_pole(spark):
    def ring(lat, lngs):
        return [(float(x), float(lat)) for x in (*lngs, lngs[0])]

    lngs = [-171.5, -100, -20, 60, 130, 175.5]
    shapes = [
        ("north", [[ring(61.3, lngs)]]),
        ("south", [[ring(-58.9, lngs[::-1])]]),
        ("band", [[ring(50.7, lngs), ring(70.1, lngs)]]),
        ("belt", [[[(-180.0, -10.3), (0.0, -10.3), (180.0, -10.3), (180.0, 20.3), (0.0, 20.3), (-180.0, 20.3), (-180.0, -10.3)]]]),
    ]
    got = filled(zones(spark, shapes), 2)

    def wanted(low, high):
        return sorted(pack(2, x, y) for y in range(54) for x in range(108) if low < (y + 0.5) * 30 / 9 - 90 < high)

    assert sorted(got["north"]) == wanted(61.3, 90)
    assert sorted(got["south"]) == wanted(-90, -58.9)
    assert sorted(got["band"]) == wanted(50.7, 70.1)
    assert sorted(got["belt"]) == wanted(-10.3, 20.3)


def test_a_wide_box_is_not_taken_round(spark):
    corners = spark.sql("select 'w' as id, -178D as x0, -30.1D as y0, 178D as x1, 40.1D as y1")
    shape = geo.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    got = polyfill(corners.select("id", F.array(shape[0]).alias("geometry")), 1)
    assert rows(got.select("h1")) == sorted([(c,) for c in brute_cells([[square(-178, -30.1, 178, 40.1)]], 1)], key=repr)
