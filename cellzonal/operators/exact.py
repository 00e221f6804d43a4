"""Points in polygons, exactly, by the edges of a point's own grid bucket.

A bucket that no edge of a part touches is wholly inside it or outside. In the others, a point
differs from the bucket's south-west corner by the edges between them: those that cross the
bucket's west side up to the point's height, and those that cross the point's row from
there to the point. So a point meets only its bucket's edges and one parity, and no shape
is ever shuffled. The edges are half-open as in the cell fill, and all comparisons are the
same as in a test against every edge, so both give the same points, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cellzonal.functions import geometry as geo, grid
from cellzonal.operators.polyfill import (
    BROADCAST_LEVEL,
    dump_parts,
    edge_cells,
    geometry_column,
    polyfill,
)
from cellzonal.session import unsized


def corner_parities(edges: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
    """``keep..., _polygon, h{level}`` of those touched buckets whose south-west corner is inside.

    Crossings of a part's edges with the lines between bucket rows and the corners that
    ask for them are counted from the east, in one shuffle by (part, row).
    """
    key = [*keep, "_polygon"]
    names = "".join(f"`{c}`, " for c in key)
    cell = f"h{level}"
    west, south, *_ = grid.corners_sql(cell, level)
    asked = edges.select(*key, cell).distinct()
    corners = asked.selectExpr(
        *[f"`{c}`" for c in key], cell, f"{grid.y_sql(cell)} as _y", f"{west} as _x", "0 as _n"
    )
    bare = edges.select(*key, "_edge", "x1", "y1", "x2", "y2", F.expr(grid.y_sql(cell)).alias("_y"))
    line = grid.corners_sql(grid.pack_sql(level, "0L", "_y"), level)[1]
    crossed = bare.where(f"(y1 > {line}) != (y2 > {line})").distinct()
    crossings = crossed.selectExpr(
        *[f"`{c}`" for c in key], f"cast(null as bigint) as {cell}", "_y",
        f"{geo.crossing_sql(line)} as _x", "1 as _n",
    )
    order = f"(partition by {names} _y order by _x desc, _n rows between unbounded preceding and current row)"
    counted = corners.unionByName(crossings).selectExpr("*", f"sum(_n) over {order} as _east")
    return counted.where(f"{cell} is not null and _east % 2 = 1").select(*key, cell)


def _flips(level: int) -> str:
    """How often an edge parts a point (_px, _py) from its bucket's corner."""
    west, south, *_ = grid.corners_sql(f"h{level}", level)

    def above(y: str) -> str:
        """Whether the edge passes the west side above a height."""
        east_end = f"(if(x1 > {west}, y1, y2) > {y})"
        return f"if((y1 > {y}) != (y2 > {y}), {east_end} != ({west} < {geo.crossing_sql(y)}), {east_end})"

    up = f"((x1 > {west}) != (x2 > {west})) and (({above('_py')}) != ({above(south)}))"
    x = geo.crossing_sql("_py")
    along = f"((y1 > _py) != (y2 > _py)) and (({west} < {x}) != (_px < {x}))"
    return f"if(x1 is null, 1, if({up}, 1, 0) + if({along}, 1, 0))"


def spatial_join(
    points: DataFrame,
    zones: DataFrame,
    x: str = "lng",
    y: str = "lat",
    keep: Sequence[str] = ("id",),
    level: int = BROADCAST_LEVEL,
) -> DataFrame:
    """points' rows with ``keep`` of each zone that holds them, once per zone.

    A zone holds a point if one of its parts does, by the even-odd rule; parts may overlap and
    zones may be listed twice. Points without coordinates and zones without id or
    shape meet nothing. ``level`` sets the size of the buckets: the finer, the fewer edges a
    point meets. Places are tested once, however many rows are there, and so is a part that
    several zones have.
    """
    missing = [c for c in (x, y) if c not in points.columns] + [c for c in keep if c not in zones.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    clash = sorted(set(points.columns) & {*keep, "_px", "_py"})
    if clash:
        raise ValueError(f"points have the columns {clash}; rename them")
    cell, key = f"h{level}", ["_mark", "_polygon"]
    shape = geometry_column(zones)
    named = zones.dropna(subset=list(keep)).select(*keep, F.col(shape).alias("geometry"))
    # A part is told from others by two hashes of 64 bits; how many zones have it doesn't matter before the end.
    hashes = "transform(geometry, r -> named_struct('_mark', xxhash64(1, r), '_polygon', xxhash64(r)))"
    listed = named.select(*keep, F.expr(hashes).alias("_parts")).select(*keep, F.inline("_parts"))
    parts = dump_parts(named.select("geometry")).select(
        F.expr("xxhash64(1, rings)").alias("_mark"),
        F.expr("xxhash64(rings)").alias("_polygon"),
        F.array("rings").alias("geometry"),
    )
    edges = edge_cells(parts, level, ["_mark"]).distinct()
    touched = edges.select(cell, *key).distinct()
    inside = polyfill(parts, level, key).select(cell, *key)
    inside = inside.join(unsized(touched), [cell, *key], "left_anti")

    placed = points.withColumns(
        {"_px": F.col(f"`{x}`").cast("double"), "_py": F.col(f"`{y}`").cast("double")}
    ).where("_px is not null and _py is not null and not isnan(_px) and not isnan(_py)")
    places = placed.select("_px", "_py").distinct()
    places = places.withColumn(cell, grid.cell_at("_px", "_py", level))
    corners = corner_parities(edges, level, ["_mark"])
    lines = unsized(edges.drop("_edge").unionByName(corners, allowMissingColumns=True))
    near = places.join(lines, cell).groupBy("_px", "_py", *key).agg(F.expr(f"sum({_flips(level)})").alias("_flips"))
    near = near.where("_flips % 2 = 1").select("_px", "_py", *key)
    hits = near.unionByName(places.join(unsized(inside), cell).select("_px", "_py", *key))
    return _of_zones(placed, hits, listed, points.columns, keep, key)


def _of_zones(
    placed: DataFrame, hits: DataFrame, listed: DataFrame, columns: Sequence[str], keep: Sequence[str], key: Sequence[str]
) -> DataFrame:
    """Rows of points with the zones whose parts hold their place, once per zone.

    Only zones of several parts can be met more than once by a place.
    """
    parts = F.count(F.lit(1)).over(Window.partitionBy(*keep)) if keep else F.lit(2)
    own = listed.distinct().withColumn("_parts", parts)
    simple, manifold = own.where("_parts = 1").drop("_parts"), own.where("_parts > 1").drop("_parts")
    some = hits.join(unsized(manifold), list(key)).select("_px", "_py", *keep).distinct()

    def free(name: str) -> str:
        return free(f"{name}_") if name in columns else name

    names = {c: free(c) for c in key}
    held = placed.join(unsized(hits.withColumnsRenamed(names)), ["_px", "_py"])
    one = held.join(unsized(simple.withColumnsRenamed(names)), list(names.values()))
    found = one.unionByName(placed.join(unsized(some), ["_px", "_py"]), allowMissingColumns=True)
    return found.select(*[F.col(f"`{c}`") for c in columns], *keep)
