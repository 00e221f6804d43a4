import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cellzonal.functions import geometry as geo, grid, h3
from tests.helpers import pack, rows

POINTS = [
    (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (29.999, 30.0), (-0.0001, 12.5),
    (179.99, -89.99), (73.13, -41.7), (-122.27, 37.87),
]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "lng double, lat double")


@pytest.mark.parametrize("level", [0, 1, 4, 8, 15])
def test_point_lies_in_its_cell(points, level):
    cells = points.withColumn("c", grid.cell_at("lng", "lat", level))
    w, s, e, n = grid.corners_sql("c", level)
    margin = 1e-9
    outside = cells.where(
        f"lng < {w} - {margin}D or lng > {e} + {margin}D or lat < {s} - {margin}D or lat > {n} + {margin}D"
    )
    assert outside.count() == 0


def test_corner_points_fall_in_the_last_cell(points):
    top = points.where("lng = 180").select(grid.cell_at("lng", "lat", 3)).first()[0]
    assert top == pack(3, 12 * 27 - 1, 6 * 27 - 1)


def test_parent_of_parent_is_parent(points):
    cells = points.select(grid.cell_at("lng", "lat", 10).alias("c"))
    cells = cells.withColumn("mid", grid.parent("c", 10, 6))
    differ = cells.where(grid.parent("mid", 6, 2) != grid.parent("c", 10, 2))
    assert differ.count() == 0
    direct = points.select(grid.cell_at("lng", "lat", 6).alias("mid"))
    assert rows(cells, "mid") == rows(direct)


@settings(max_examples=200, deadline=None)
@given(
    st.integers(0, 12 * 3**9 - 1), st.integers(0, 6 * 3**9 - 1), st.integers(0, 9)
)
def test_parent_arithmetic_nests(x, y, k):
    """The packing rule itself: a child's square lies in its parent's."""
    d = 3 ** (9 - k)
    px, py = x // d, y // d
    assert px * d <= x < (px + 1) * d and py * d <= y < (py + 1) * d
    assert px < 12 * 3**k and py < 6 * 3**k


def test_parent_cannot_be_finer():
    with pytest.raises(ValueError):
        grid.parent("c", 3, 4)
    with pytest.raises(ValueError):
        h3.parent("c", 3, 4)


def test_text_round_trip_of_either_case(points):
    cells = points.select(grid.cell_at("lng", "lat", 9).alias("c"))
    for upper in (False, True):
        text = cells.withColumn("t", grid.to_text(F.col("c"), upper))
        assert text.where(grid.from_text(F.col("t")) != F.col("c")).count() == 0
        sample = text.first()["t"]
        assert sample == (sample.upper() if upper else sample.lower())


def test_h3_parents_of_a_published_cell(spark):
    cell = spark.sql("select conv('8928308280fffff', 16, 10) + 0L as c").select(
        F.col("c").cast("long").alias("c")
    )
    got = cell.select(
        *[grid.to_text(h3.parent("c", 9, k)).alias(f"h{k}") for k in (9, 8, 5, 0)],
        h3.resolution("c").alias("r"),
    ).first()
    # The published ancestors of this cell.
    assert tuple(got) == (
        "8928308280fffff", "8828308281fffff", "85283083fffffff", "8029fffffffffff", 9,
    )


def test_cell_counts():
    assert [grid.cell_count(k) for k in (0, 1, 4)] == [72, 648, 472392]
    assert [h3.cell_count(k) for k in (0, 1, 4)] == [122, 842, 288122]


def test_hex_columns_and_finest_by_number():
    names = ["h1", "h9", "h10", "hx", "h123", "height", "h0"]
    assert grid.hex_columns(names) == ["h1", "h9", "h10", "h0"]
    assert grid.finest_hex_column(names) == "h10"
    with pytest.raises(ValueError):
        grid.finest_hex_column(["a"])


@pytest.mark.parametrize("zoom,level", [(0.3, 1), (5.99, 5), (10, 10), (17.2, 10), (-3, 1)])
def test_zoom_to_level(zoom, level):
    assert grid.zoom_to_level(zoom) == level


def test_boundary_and_wkt(spark):
    df = spark.range(1).select(F.lit(pack(1, 18, 9)).alias("c"))
    wkt = df.select(geo.to_wkt(grid.boundary("c", 1), 1)).first()[0]
    assert wkt == "POLYGON ((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0))"


def test_wkt_round_trip(spark):
    texts = [
        "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 0.5, 2.0 0.5, 2.0 1.0, 1.0 0.5))",
        "MULTIPOLYGON (((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0)), ((-5.5 -5.0, -4.0 -5.0, -4.0 -4.0, -5.5 -5.0)))",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "wkt string")
    again = df.select(geo.to_wkt(geo.from_wkt(F.col("wkt")), 1).alias("again"))
    assert [r[0] for r in again.collect()] == texts
    other = spark.createDataFrame([("POINT (1 2)",)], "wkt string")
    assert other.select(geo.from_wkt(F.col("wkt"))).first()[0] is None


def test_clamped_box(spark):
    df = spark.createDataFrame([(-190.0, -95.0, 185.0, 91.0)], "xmin double, ymin double, xmax double, ymax double")
    box = df.select(geo.clamped_box(*[F.col(c) for c in df.columns]).alias("g"))
    b = box.select(geo.bounds_of(F.col("g")).alias("b")).select("b.*").first()
    assert tuple(b) == (-178.0, -89.99, 178.0, 89.99)
    assert math.isclose(b["xmax"], 178.0)


def test_zoom_to_level_column(spark):
    zooms = [-3.0, 0.9, 1.99, 7.5, 10.2, 1e300, None]
    rows = spark.createDataFrame([(z,) for z in zooms], "zoom double")
    got = [r[0] for r in rows.select(grid.zoom_to_level_column("zoom")).collect()]
    assert got == [grid.zoom_to_level(z) if z is not None else None for z in zooms]
