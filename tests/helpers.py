"""Small tables for tests and plain-Python answers to compare with."""

from __future__ import annotations

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def zones(spark, rows, id_type="string"):
    """``rows`` are (id, parts); a part is a list of closed rings of (x, y)."""
    return spark.createDataFrame(rows, f"id {id_type}, geometry {GEOMETRY}")


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def square_zone(x0, y0, x1, y1):
    return [[square(float(x0), float(y0), float(x1), float(y1))]]


def inside(part, px, py):
    odd = False
    for ring in part:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def pack(level, x, y):
    return (level << 56) | (y << 28) | x


def brute_cells(parts, level):
    """Cells whose centre is in some part, by testing every cell."""
    n = 3**level
    return {
        pack(level, x, y)
        for y in range(6 * n)
        for x in range(12 * n)
        if any(inside(p, (x + 0.5) * 30 / n - 180, (y + 0.5) * 30 / n - 90) for p in parts)
    }


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

