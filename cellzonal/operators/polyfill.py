"""Polygons to grid cells, as a distributed scanline fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cellzonal.functions import geometry as geo, grid
from cellzonal.session import unsized

# A cell set is broadcast only at a level whose whole grid has at most this many cells.
BROADCAST_CELLS = 500_000
# Coarsest level of a compact fill: the finest whose whole grid may be broadcast.
BROADCAST_LEVEL = max(
    k for k in range(grid.MAX_LEVEL) if grid.cell_count(k) <= BROADCAST_CELLS
)


def dump_parts(zones: DataFrame, geometry: str = "geometry", part: str = "part") -> DataFrame:
    """One row per polygon part, numbered from 0."""
    rest = [c for c in zones.columns if c != geometry]
    return zones.select(*rest, F.posexplode(geometry).alias(part, "rings"))


def geometry_column(zones: DataFrame) -> str:
    """Name of the geometry column: ``geometry``, else ``geom``."""
    for name in ("geometry", "geom"):
        if name in zones.columns:
            return name
    raise ValueError(f"no geometry column among {zones.columns}")


def _centre_index(degrees: str, origin: float, n: int) -> str:
    """Index of the first cell centre at or beyond a coordinate."""
    return f"ceil(({degrees} + {origin}D) * {float(n)}D / {grid.BASE_DEGREES}D - 0.5D)"


def scanline_runs(zones: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
    """Runs ``(keep..., y, x0, x1)`` of cells whose centre lies in a zone.

    Only edge crossings travel: one row per (edge, cell row), shuffled once by
    (zone, cell row). Work per task follows the outline, not the area, so one
    huge polygon spreads over all tasks. Runs of one zone never overlap.
    """
    missing = [c for c in keep if c not in zones.columns]
    if missing:
        raise ValueError(f"id columns {missing} not in {zones.columns}")
    n = grid.splits(level)
    rows, columns = grid.BASE_ROWS * n, grid.BASE_COLUMNS * n

    key = "".join(f"`{c}`, " for c in keep)
    # One spare row on both sides of an edge; the crossing test decides.
    low = f"greatest({_centre_index('least(y1, y2)', 90.0, n)} - 1, 0L)"
    high = f"least({_centre_index('greatest(y1, y2)', 90.0, n)}, {rows - 1}L)"
    y_centre = f"((cast(_y as double) + 0.5D) * {grid.BASE_DEGREES}D / {float(n)}D - 90D)"
    # A zone listed twice brings every crossing twice, next to each other in this order.
    in_part = f"(partition by {key} _y, _part, _shape order by _x, _edge)"
    # Parts of one zone may overlap: each run starts after what is already covered.
    earlier = f"(partition by {key} _y order by x0, x1 rows between unbounded preceding and 1 preceding)"
    parts = (
        f"select {key} posexplode(`{geometry_column(zones)}`) as (_part, rings) from {{zones}}"
    )
    edges = (
        f"select {key} _part, xxhash64(rings) as _shape, "
        f"posexplode({geo.edges_sql('rings')}) as (_edge, _e) from ({parts})"
    )
    ends = f"select {key} _part, _shape, _edge, _e.* from ({edges}) where _e.y1 != _e.y2"
    in_rows = (
        f"select *, explode(case when {low} <= {high} then sequence({low}, {high}) end) as _y "
        f"from ({ends})"
    )
    # A fixed number of tasks: the few bytes here grow into many cells, which
    # Spark would not foresee when merging small partitions.
    tasks = zones.sparkSession.conf.get("spark.sql.shuffle.partitions")
    crossings = (
        f"select /*+ repartition({tasks}, {key} _y) */ {key} _part, _shape, _edge, _y, "
        f"{geo.crossing_sql(y_centre)} as _x "
        f"from ({in_rows}) where (y1 > {y_centre}) != (y2 > {y_centre})"
    )
    marked = f"select *, lag(_edge) over {in_part} as _previous from ({crossings})"
    paired = (
        f"select {key} _y, _x, lead(_x) over {in_part} as _end, row_number() over {in_part} as _rank "
        f"from ({marked}) where _previous is null or _previous != _edge"
    )
    runs = (
        f"select {key} _y, greatest({_centre_index('_x', 180.0, n)}, 0L) as x0, "
        f"least({_centre_index('_end', 180.0, n)} - 1, {columns - 1}L) as x1 "
        f"from ({paired}) where _rank % 2 = 1"
    )
    covered = f"select *, max(x1) over {earlier} as _covered from ({runs}) where x0 <= x1"
    clear = (
        f"select {key} _y as y, greatest(x0, coalesce(_covered + 1, x0)) as x0, x1 from ({covered})"
    )
    return zones.sparkSession.sql(f"select * from ({clear}) where x0 <= x1", zones=zones)


def polyfill(zones: DataFrame, level: int, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Cells ``h0, h{level}, keep...`` whose centre lies in a zone (G1).

    Rows are unique. With ``keep=()`` the result is the plain set of cells. A feature's
    ``point``, where there is that column, gives the cell that holds it (G7).
    """
    cell, key = f"h{level}", "".join(f", `{c}`" for c in keep)
    base = "" if level == 0 else f"{grid.parent_sql('_cell', level, 0)} as h0, "
    filled = f"select y, explode(sequence(x0, x1)) as x{key} from {{runs}}"
    cells = f"select {grid.pack_sql(level, 'x', 'y')} as _cell{key} from ({filled})"
    named = f"select {base}_cell as {cell}{key} from "
    area = zones.sparkSession.sql(f"{named}({cells})", runs=scanline_runs(zones, level, keep))
    points = point_cells(zones, level, keep)
    if points is None:
        return area
    runs = scanline_runs(zones, level, keep)
    return area.unionByName(zones.sparkSession.sql(f"{named}{{points}}", points=_outside(points, runs, keep)))


def run_area(zones: DataFrame, level: int, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The cells of ``polyfill`` as runs ``r{level}, x0, x1, keep...`` of a row's columns.

    A zone has about one run in each row it spans, whatever its width, and its runs never
    overlap. Ids must not be null.
    """
    runs = scanline_runs(zones, level, keep)
    points = point_cells(zones, level, keep)
    if points is not None:
        free = _outside(points, runs, keep)
        x = F.expr(grid.x_sql("_cell"))
        ids = [F.col(f"`{c}`") for c in keep]
        free = free.select(F.expr(grid.y_sql("_cell")).alias("y"), x.alias("x0"), x.alias("x1"), *ids)
        runs = runs.unionByName(free)
    return runs.select(F.col("y").alias(f"r{level}"), "x0", "x1", *[F.col(f"`{c}`") for c in keep])


def point_cells(zones: DataFrame, level: int, keep: Sequence[str]) -> DataFrame | None:
    """Rows ``_cell, keep...`` of the cells that hold a feature's ``point``, if any may."""
    if dict(zones.dtypes).get("point") != geo.POINT_TYPE:
        return None
    ids = [F.col(f"`{c}`") for c in keep]
    places = zones.where("point is not null")
    return places.select(grid.cell_at("point.x", "point.y", level).alias("_cell"), *ids)


def edge_cells(zones: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
    """Edges ``keep..., _polygon, _edge, x1, y1, x2, y2`` with each native cell they pass through.

    ``_polygon`` tells a zone's parts apart. A cell that an edge only just misses may be there.
    """
    ids = [f"`{c}`" for c in keep]
    shape = geometry_column(zones)
    edges = (
        dump_parts(zones.select(*ids, shape), shape)
        .selectExpr(*ids, "xxhash64(rings) as _polygon", f"posexplode({geo.edges_sql('rings')}) as (_edge, _e)")
        .selectExpr(*ids, "_polygon", "_edge", "_e.*")
    )

    def row(y: str) -> str:
        return grid.index_sql(y, 90.0, level, grid.BASE_ROWS)

    def column(x: str) -> str:
        return grid.index_sql(x, 180.0, level, grid.BASE_COLUMNS)

    def x_at(y: str) -> str:
        return f"greatest(least({geo.crossing_sql(y)}, greatest(x1, x2)), least(x1, x2))"

    margin = "1e-9D"
    low, high = row(f"least(y1, y2) - {margin}"), row(f"greatest(y1, y2) + {margin}")
    by_row = edges.selectExpr("*", f"explode(sequence({low}, {high})) as _y")
    # Part of the edge within the row; a level edge is there in full length.
    width = f"{grid.BASE_DEGREES}D / {float(grid.splits(level))}D"
    south, north = f"(_y * {width} - 90D - {margin})", f"((_y + 1) * {width} - 90D + {margin})"

    def inside(y: str) -> str:
        return f"greatest(least({y}, greatest(y1, y2)), least(y1, y2))"

    spans = by_row.selectExpr(
        "*",
        f"if(y1 = y2, x1, {x_at(inside(south))}) as _a",
        f"if(y1 = y2, x2, {x_at(inside(north))}) as _b",
    )
    left, right = column(f"least(_a, _b) - {margin}"), column(f"greatest(_a, _b) + {margin}")
    placed = spans.selectExpr("*", f"explode(sequence({left}, {right})) as _x")
    return placed.select(
        *ids, "_polygon", "_edge", "x1", "y1", "x2", "y2",
        grid.pack(level, "_x", "_y").alias(f"h{level}"),
    )


def _outside(points: DataFrame, runs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Different cells of points that no run of the same zone covers; runs are not exploded."""
    key = "".join(f"`{c}`, " for c in keep)
    rows = points.distinct().selectExpr(
        *[f"`{c}`" for c in keep], f"{grid.y_sql('_cell')} as y", f"{grid.x_sql('_cell')} as x0",
        "cast(null as bigint) as x1", "_cell",
    )
    rows = rows.unionByName(runs, allowMissingColumns=True)
    order = f"(partition by {key} y order by x0, x1 desc rows between unbounded preceding and current row)"
    seen = rows.selectExpr("*", f"max(x1) over {order} as _covered")
    free = seen.where("_cell is not null and (_covered is null or _covered < x0)")
    return free.select("_cell", *[F.col(f"`{c}`") for c in keep])


def touched_cells(zones: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
    """Native cells that an outline of a zone passes through, one row each."""
    return edge_cells(zones, level, keep).select(f"h{level}", *[f"`{c}`" for c in keep]).distinct()


def compact_fill(
    zones: DataFrame,
    level: int,
    keep: Sequence[str] = ("id",),
    start: int = BROADCAST_LEVEL,
    step: int = 2,
) -> DataFrame:
    """The cells of ``polyfill`` with whole blocks given as one coarser cell.

    Rows ``cell, keep...`` of levels ``start .. level``; no two of one zone
    overlap. Only cells that an outline passes through are looked at again at a
    finer level, so the result grows with the outline of a zone, not its area.
    Ids must not be null.
    """
    points, zones = point_cells(zones, level, keep), zones.drop("point")
    levels = [*range(min(start, level), level, step), level]
    result, outline, above = None, None, None
    for k in levels:
        key = [f"h{k}", *keep]
        if outline is None:
            inside = polyfill(zones, k, keep).select(*key)
        else:
            inside = _filled_within(zones, k, outline, above, keep)
        if k < level:
            touched = touched_cells(zones, k, keep)
            if outline is not None:
                ancestors = touched.withColumn(f"h{above}", grid.parent(f"h{k}", k, above))
                touched = ancestors.join(unsized(outline), [f"h{above}", *keep], "left_semi").select(*key)
            inside = inside.join(unsized(touched), key, "left_anti")
            outline, above = touched, k
        cells = inside.select(F.col(f"h{k}").alias("cell"), *keep)
        result = cells if result is None else result.unionByName(cells)
    if points is None:
        return result
    return _with_points(result, points.withColumnRenamed("_cell", "cell").distinct(), level, keep)


def blocks_from(area: DataFrame, coarsest: int) -> DataFrame:
    """A compact area without blocks coarser than a level: these are cut into its cells.

    At a level that may be broadcast, a zone has no more of them than its whole grid.
    """
    x, y = grid.x_sql("cell"), grid.y_sql("cell")
    side = f"cast(pow(3, greatest({coarsest} - shiftright(cell, 56), 0)) as bigint)"
    row = f"transform(sequence(0L, {side} - 1), _i -> {grid.pack_sql(coarsest, f'{x} * {side} + _i', f'{y} * {side} + _j')})"
    cut = f"flatten(transform(sequence(0L, {side} - 1), _j -> {row}))"
    own = F.expr(f"if(shiftright(cell, 56) < {coarsest}, {cut}, array(cell))")
    rest = [F.col(f"`{c}`") for c in area.columns if c != "cell"]
    return area.select(F.explode(own).alias("cell"), *rest)


def _with_points(blocks: DataFrame, points: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
    """Blocks and those cells of points that lie in no block of the same zone."""
    coarsest = min(BROADCAST_LEVEL, level)
    lines = [grid.parent("cell", level, k) for k in range(coarsest, level + 1)]
    above = points.withColumn("_above", F.explode(F.array(*lines)))
    met = blocks_from(blocks, coarsest).withColumnRenamed("cell", "_above")
    within = above.join(unsized(met), ["_above", *keep], "left_semi").select("cell", *keep)
    return blocks.unionByName(points.join(unsized(within), ["cell", *keep], "left_anti").select("cell", *keep))


def _filled_within(
    zones: DataFrame, level: int, outline: DataFrame, above: int, keep: Sequence[str]
) -> DataFrame:
    """Cells of a finer level inside a zone and within one of its ``outline`` cells.

    Runs and cells of one row are merged in order of x, so none are paired off.
    """
    side, block = 3 ** (level - above), f"h{above}"
    runs = scanline_runs(zones, level, keep).select(
        *keep, "y", F.col("x0").alias("x"), F.col("x1").alias("_end")
    )
    last = side - 1
    cells = (
        outline.selectExpr(
            *[f"`{c}`" for c in keep],
            f"{grid.x_sql(block)} * {side}L as _x",
            f"explode(sequence({grid.y_sql(block)} * {side}L, {grid.y_sql(block)} * {side}L + {last}L)) as y",
        )
        .withColumn("x", F.expr(f"explode(sequence(_x, _x + {last}L))"))
        .select(*keep, "y", "x", F.lit(None).cast("long").alias("_end"))
    )
    key = "".join(f"`{c}`, " for c in keep)
    order = f"(partition by {key} y order by x, _end desc rows between unbounded preceding and current row)"
    merged = runs.unionByName(cells).selectExpr("*", f"max(_end) over {order} as _covered")
    inside = merged.where("_end is null and _covered >= x")
    return inside.select(grid.pack(level, "x", "y").alias(f"h{level}"), *keep)


def polyfill_retrying(
    zones: DataFrame, level: int, finest: int, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """Fill at ``level``; zones left without any cell go one level finer.

    Rows are ``level, cell, keep...``; a zone appears at one level only.
    """
    filled, rest = None, zones
    for r in range(level, finest + 1):
        cells = polyfill(rest, r, keep)
        found = cells.select(F.lit(r).alias("level"), F.col(f"h{r}").alias("cell"), *keep)
        filled = found if filled is None else filled.unionByName(found)
        if r < finest:
            done = scanline_runs(rest, r, keep).select(*keep)
            points = point_cells(rest, r, keep)
            done = done if points is None else done.unionByName(points.select(*keep))
            done = done.distinct()
            rest = rest.join(done, list(keep), "left_anti")
    return filled


def base_grid(facts: DataFrame) -> DataFrame:
    """Distinct base cells of a table with their outline."""
    return facts.select("h0").distinct().withColumn("geom", grid.boundary("h0", 0))
