"""H3 cell ids: parent and resolution by bit arithmetic, as Column expressions.

Bits of an id: 1 reserved, 4 mode, 3 reserved, 4 resolution (offset 52),
7 base cell, then fifteen 3-bit digits; digits below the resolution are all 1.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_LEVEL = 15
_RESOLUTION_OFFSET = 52


def cell_count(level: int) -> int:
    """Number of cells at a resolution: 12 pentagons and the hexagons."""
    return 2 + 120 * 7**level


def resolution(cell: str) -> Column:
    return F.expr(f"cast(shiftright({cell}, {_RESOLUTION_OFFSET}) & 15L as int)")


def parent(cell: str, level: int, to_level: int) -> Column:
    """Ancestor of a cell at a coarser resolution."""
    if not 0 <= to_level <= level <= MAX_LEVEL:
        raise ValueError(f"cannot go from level {level} to {to_level}")
    if to_level == level:
        return F.expr(cell)
    keep = ~(15 << _RESOLUTION_OFFSET)
    unused_digits = (1 << 3 * (MAX_LEVEL - to_level)) - 1
    return F.expr(f"({cell} & {keep}L) | {(to_level << _RESOLUTION_OFFSET) | unused_digits}L")
