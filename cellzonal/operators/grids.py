"""The two kinds of cell id a table may be keyed by, behind one interface.

``NativeGrid`` computes everything. ``DictionaryGrid`` serves H3 ids: parents
by bit arithmetic, centres and outlines from a table ``(cell, lng, lat,
boundary)`` that the user supplies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from cellzonal.functions import grid, h3
from cellzonal.operators.exact import spatial_join
from cellzonal.operators.polyfill import polyfill


class Grid(Protocol):
    def cell_count(self, level: int) -> int: ...

    def parent(self, cell: str, level: int, to_level: int) -> Column: ...

    def polyfill(self, zones: DataFrame, level: int, keep: Sequence[str]) -> DataFrame: ...

    def with_boundary(self, df: DataFrame, cell: str, level: int, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class NativeGrid:
    def cell_count(self, level: int) -> int:
        return grid.cell_count(level)

    def parent(self, cell: str, level: int, to_level: int) -> Column:
        return grid.parent(cell, level, to_level)

    def polyfill(self, zones: DataFrame, level: int, keep: Sequence[str] = ("id",)) -> DataFrame:
        return polyfill(zones, level, keep)

    def with_boundary(self, df: DataFrame, cell: str, level: int, name: str = "geom") -> DataFrame:
        return df.withColumn(name, grid.boundary(cell, level))


@dataclass(frozen=True)
class DictionaryGrid:
    """H3 ids with a cell dictionary holding one resolution.

    A cell the dictionary lacks lies in no zone and has no outline.
    """

    dictionary: DataFrame
    bucket_level: int = 4

    def cell_count(self, level: int) -> int:
        return h3.cell_count(level)

    def parent(self, cell: str, level: int, to_level: int) -> Column:
        return h3.parent(cell, level, to_level)

    def polyfill(self, zones: DataFrame, level: int, keep: Sequence[str] = ("id",)) -> DataFrame:
        """Dictionary cells whose centre lies in a zone.

        Centres and zones meet on native-grid buckets, where a centre meets the edges of its
        bucket only. Point features give no cell, as a dictionary tells no cell's exact extent.
        """
        centres = self.dictionary.select(F.col("cell").alias("_cell"), "lng", "lat")
        met = spatial_join(centres, zones, "lng", "lat", keep, self.bucket_level)
        cells = met.select(F.col("_cell").alias("cell"), *keep).distinct()
        if level == 0:
            return cells.select(F.col("cell").alias("h0"), *keep)
        return cells.select(
            self.parent("cell", level, 0).alias("h0"),
            F.col("cell").alias(f"h{level}"),
            *keep,
        )

    def with_boundary(self, df: DataFrame, cell: str, level: int, name: str = "geom") -> DataFrame:
        outlines = self.dictionary.select(F.col("cell").alias(cell), F.col("boundary").alias(name))
        return df.join(outlines, cell, "left")


NATIVE = NativeGrid()
