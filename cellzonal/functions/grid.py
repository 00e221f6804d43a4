"""Native square-degree grid: every operation is a Column expression.

Arguments are column names or SQL expressions, so each result is one ``expr``.

Level ``r`` splits the world into ``12 * 3^r`` columns and ``6 * 3^r`` rows of
cells ``30 / 3^r`` degrees wide. A cell id packs ``(level, y, x)`` in one
BIGINT, so a parent is plain integer arithmetic and never needs a lookup.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

BASE_DEGREES = 30.0
BASE_COLUMNS, BASE_ROWS = 12, 6
MAX_LEVEL = 15
# Lowest and highest zoom a user may pick.
ZOOM_RANGE = (1, 10)
LEVEL_STEP = 1 << 56
ROW_STEP = 1 << 28

_HEX_COLUMN = re.compile(r"h(\d{1,2})")


def level_of(column: str) -> int:
    """Level named by a cell column: ``level_of("h7") == 7``."""
    match = _HEX_COLUMN.fullmatch(column)
    if match is None:
        raise ValueError(f"not a cell column: {column!r}")
    return int(match.group(1))


def hex_columns(columns: list[str]) -> list[str]:
    """Cell columns ``h0 .. h99`` in table order."""
    return [c for c in columns if _HEX_COLUMN.fullmatch(c)]


def finest_hex_column(columns: list[str]) -> str:
    """Cell column of the highest level, compared as numbers (P10)."""
    found = hex_columns(columns)
    if not found:
        raise ValueError(f"no cell column among {columns}")
    return max(found, key=level_of)


def zoom_to_level(zoom: float) -> int:
    """Map zoom to a grid level: cut the fraction, keep within the slider's range."""
    return max(ZOOM_RANGE[0], min(ZOOM_RANGE[1], int(zoom)))


def zoom_to_level_column(zoom: str) -> Column:
    """The grid level of a column of map zooms; null stays null."""
    low, high = ZOOM_RANGE
    return F.expr(f"if({zoom} is null, null, int(greatest({low}, least({high}, {zoom}))))")


def splits(level: int) -> int:
    """Cells along one side of a base square."""
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level must be 0..{MAX_LEVEL}, got {level}")
    return 3**level


def cell_count(level: int) -> int:
    """Number of cells in the whole grid: the size bound of any cell set."""
    return BASE_COLUMNS * BASE_ROWS * 9**level


def pack_sql(level: int, x: str, y: str) -> str:
    return f"({level * LEVEL_STEP}L + ({y}) * {ROW_STEP}L + ({x}))"


def x_sql(cell: str) -> str:
    return f"({cell} & {ROW_STEP - 1}L)"


def y_sql(cell: str) -> str:
    return f"(shiftright({cell}, 28) & {ROW_STEP - 1}L)"


def index_sql(degrees: str, origin: float, level: int, bound: int) -> str:
    """Row or column of a coordinate, kept within the grid."""
    at = f"floor(({degrees} + {origin}D) * {float(splits(level))}D / {BASE_DEGREES}D)"
    return f"greatest(least({at}, {bound * splits(level) - 1}L), 0L)"


def pack(level: int, x: str, y: str) -> Column:
    """Cell id of a column and a row, given as SQL expressions."""
    return F.expr(pack_sql(level, x, y))


def cell_at(lng: str, lat: str, level: int) -> Column:
    """Cell holding a point (G7); lng 180 and lat 90 belong to the last cell."""
    return pack(
        level, index_sql(lng, 180.0, level, BASE_COLUMNS), index_sql(lat, 90.0, level, BASE_ROWS)
    )


def parent_sql(cell: str, level: int, to_level: int) -> str:
    if to_level > level:
        raise ValueError(f"level {to_level} is finer than {level}")
    if to_level == level:
        return cell
    step = 3 ** (level - to_level)
    return pack_sql(to_level, f"{x_sql(cell)} div {step}L", f"{y_sql(cell)} div {step}L")


def parent(cell: str, level: int, to_level: int) -> Column:
    """Ancestor of a level-``level`` cell at a coarser level."""
    return F.expr(parent_sql(cell, level, to_level))


def ancestor(cell: str, to_level: int) -> Column:
    """Ancestor at one level of cells whose own levels differ."""
    step = f"cast(pow(3, shiftright({cell}, 56) - {to_level}) as bigint)"
    return pack(to_level, f"{x_sql(cell)} div {step}", f"{y_sql(cell)} div {step}")


def corners_sql(cell: str, level: int) -> tuple[str, str, str, str]:
    """``(xmin, ymin, xmax, ymax)`` of a cell."""
    width = f"{BASE_DEGREES}D / {float(splits(level))}D"
    x, y = f"cast({x_sql(cell)} as double)", f"cast({y_sql(cell)} as double)"
    return (
        f"({x} * {width} - 180D)",
        f"({y} * {width} - 90D)",
        f"(({x} + 1D) * {width} - 180D)",
        f"(({y} + 1D) * {width} - 90D)",
    )


def boundary(cell: str, level: int) -> Column:
    """Cell outline as a geometry: one part, one closed ring."""
    w, s, e, n = corners_sql(cell, level)
    ring = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    points = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in ring)
    return F.expr(f"array(array(array({points})))")


def to_text(cell: Column, upper: bool = False) -> Column:
    """Cell id as hexadecimal text."""
    text = F.hex(cell)
    return text if upper else F.lower(text)


def from_text(text: Column) -> Column:
    """Cell id from hexadecimal text of either case."""
    return F.conv(text, 16, 10).cast("long")
