"""Geometry values: ``array<array<array<struct<x,y>>>>`` = parts, rings, points.

The first ring of a part is its outline, later rings are holes; rings are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINT_TYPE = "struct<x:double,y:double>"
RING_TYPE = f"array<{POINT_TYPE}>"
PART_TYPE = f"array<{RING_TYPE}>"
GEOMETRY_TYPE = f"array<{PART_TYPE}>"

# How far a map view may reach.
LNG_LIMIT, LAT_LIMIT = 178.0, 89.99


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    """Closed ring through the given corners."""
    return F.array(*[point(x, y) for x, y in (*points, points[0])])


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Box from west to east; a wide one has corners half way, so that no edge is taken round."""
    half = (xmin + xmax) / 2
    plain = ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax))
    wide = ring((xmin, ymin), (half, ymin), (xmax, ymin), (xmax, ymax), (half, ymax), (xmin, ymax))
    return F.array(F.array(F.when(xmax - xmin > 180, wide).otherwise(plain)))


def clamped_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Map view as a polygon, kept off the poles and the date line."""
    return box(
        F.greatest(xmin, F.lit(-LNG_LIMIT)),
        F.greatest(ymin, F.lit(-LAT_LIMIT)),
        F.least(xmax, F.lit(LNG_LIMIT)),
        F.least(ymax, F.lit(LAT_LIMIT)),
    )


# An edge this long in degrees of longitude goes round the other way; one around the
# whole map, as the lower side of a world box, is meant as it stands.
_ROUND = "abs(e.x2 - e.x1) > 180D and abs(e.x2 - e.x1) < 360D - 1e-6D"
# The meridian, 180 or -180, that an edge across the date line leaves by, and its latitude there.
_EXIT = "if(e.x1 > 0D, 180D, -180D)"
_EXIT_Y = f"(e.y1 + (e.y2 - e.y1) * ({_EXIT} - e.x1) / (e.x2 + 2D * {_EXIT} - e.x1))"


def _edge(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"named_struct('x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2})"


def _cut_sql(ring: str) -> str:
    """A ring's edges cut at the date line, with edges along it that close both sides.

    Each crossing is tied to the first one's latitude, or to the pole that the ring goes
    around, on both sides of the map: doubled stretches cancel out by the even-odd rule,
    so no crossings need be paired and closing edges are as short as the crossings' range.
    """
    crossings = f"filter({ring}, e -> {_ROUND})"
    south = f"aggregate({ring}, 0D, (s, e) -> s + e.y1) < 0D"
    first = f"transform(slice({crossings}, 1, 1), e -> {_EXIT_Y})[0]"
    tie = f"if(size({crossings}) % 2 = 0, {first}, if({south}, -90D, 90D))"
    pieces = ", ".join(
        [
            _edge("e.x1", "e.y1", _EXIT, _EXIT_Y),
            _edge(f"- {_EXIT}", _EXIT_Y, "e.x2", "e.y2"),
            _edge("180D", _EXIT_Y, "180D", "t"),
            _edge("-180D", _EXIT_Y, "-180D", "t"),
        ]
    )
    cut = f"flatten(transform({ring}, e -> if({_ROUND}, array({pieces}), array(e))))"
    return f"transform(array({tie}), t -> {cut})[0]"


def edges_sql(part: str) -> str:
    """All edges of a part's rings as ``array<struct<x1,y1,x2,y2>>``.

    An edge longer than 180 degrees of longitude is taken the short way, across the date
    line, and cut there; a ring that crosses it an odd number of times holds the pole of
    its half of the globe.
    """
    ring_edges = (
        "zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), "
        f"(p, q) -> {_edge('p.x', 'p.y', 'q.x', 'q.y')})"
    )
    rings = f"transform(filter({part}, r -> size(r) > 1), r -> {ring_edges})"
    return f"flatten(transform({rings}, s -> if(exists(s, e -> {_ROUND}), {_cut_sql('s')}, s)))"


def wrapped(geometry: Column) -> Column:
    """Geometry with every longitude within -180 .. 180, as maps scrolled beyond draw it.

    A shape that reaches beyond 180 then crosses the date line; without this, what lies beyond is
    off the grid. Shapes wider than the world have no such form.
    """
    return F.transform(
        geometry,
        lambda part: F.transform(
            part,
            lambda r: F.transform(
                r,
                lambda p: point(
                    F.when(F.abs(p["x"]) > 180, F.pmod(p["x"] + 180, F.lit(360.0)) - 180).otherwise(p["x"]),
                    p["y"],
                ),
            ),
        ),
    )


def crossing_sql(y: str, e: str = "") -> str:
    """Where an edge meets the horizontal line ``y``; null on a level edge."""
    return f"try_divide(({e}x2 - {e}x1) * ({y} - {e}y1), {e}y2 - {e}y1) + {e}x1"


def points_of(geometry: Column) -> Column:
    """Every vertex of a geometry as one array."""
    return F.flatten(F.flatten(geometry))


def bounds_of(geometry: Column) -> Column:
    """Extent of one geometry as ``struct<xmin,ymin,xmax,ymax>``."""
    points = points_of(geometry)
    xs, ys = points.getField("x"), points.getField("y")
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def contains(geometry: str, x: str, y: str) -> Column:
    """Even-odd point test; edges are half-open, as in the cell fill."""
    crossed = f"((e.y1 > {y}) != (e.y2 > {y})) and ({x} < {crossing_sql(y, 'e.')})"
    return F.expr(
        f"exists({geometry}, part -> size(filter({edges_sql('part')}, e -> {crossed})) % 2 = 1)"
    )


def coordinates(geometry: Column) -> Column:
    """Geometry as GeoJSON MultiPolygon coordinates."""
    return F.transform(
        geometry,
        lambda part: F.transform(
            part, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
        ),
    )


def from_coordinates(parts: Column) -> Column:
    """Geometry from MultiPolygon coordinates ``array<array<array<array<double>>>>``."""
    return F.transform(
        parts,
        lambda part: F.transform(
            part, lambda r: F.transform(r, lambda p: point(p[0], p[1]))
        ),
    )


def to_wkt(geometry: Column, digits: int = 6) -> Column:
    """Geometry as WKT text: POLYGON for one part, else MULTIPOLYGON."""

    def ring_text(r: Column) -> Column:
        texts = F.transform(
            r, lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["x"], p["y"])
        )
        return F.concat(F.lit("("), F.array_join(texts, ", "), F.lit(")"))

    def part_text(part: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(part, ring_text), ", "), F.lit(")"))

    parts = F.transform(geometry, part_text)
    return F.when(F.size(geometry) == 1, F.concat(F.lit("POLYGON "), parts[0])).otherwise(
        F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")"))
    )


def from_wkt(text: Column) -> Column:
    """Geometry from POLYGON or MULTIPOLYGON WKT; null for any other kind."""
    kind = F.upper(F.trim(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1)))
    body = F.regexp_replace(text, r"^\s*[A-Za-z]+\s*", "")
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pairs = F.regexp_replace(body, rf"{number}\s+{number}", r"[$1,$2]")
    nested = F.translate(pairs, "()", "[]")
    as_parts = F.when(kind == "POLYGON", F.concat(F.lit("["), nested, F.lit("]"))).when(
        kind == "MULTIPOLYGON", nested
    )
    return from_coordinates(F.from_json(as_parts, "array<array<array<array<double>>>>"))
