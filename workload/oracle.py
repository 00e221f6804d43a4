"""DuckDB SQL giving the expected result of each query by plain arithmetic.

Cells come from testing every centre in a zone's bounding box, not from the
scanline fill the engine uses.
"""

from __future__ import annotations

from cellzonal.operators.taxa import RANKS
from workload import tables as t

L, R = 1 << 56, 1 << 28
LOW = R - 1


def cell(lng: str, lat: str, r: int) -> str:
    n = 3**r
    x = f"least(CAST(floor(({lng} + 180)*{n}/30) AS BIGINT), {12 * n - 1})"
    y = f"least(CAST(floor(({lat} + 90)*{n}/30) AS BIGINT), {6 * n - 1})"
    return f"({r * L} + {y}*{R} + {x})"


def up(c: str, r: int, k: int) -> str:
    d = 3 ** (r - k)
    return f"({k * L} + ((({c}) >> 28) & {LOW})//{d}*{R} + (({c}) & {LOW})//{d})"


def crosses(p: str, q: str, x: str = "px", y: str = "py") -> str:
    """1 where a ray to the east of a place meets the edge between two corners."""
    return (
        f"CASE WHEN ({p}y > {y}) <> ({q}y > {y}) AND "
        f"{x} < ({q}x - {p}x)*({y} - {p}y)/({q}y - {p}y) + {p}x THEN 1 ELSE 0 END"
    )


def cells(corners: str, r: int, key: str = "id") -> str:
    """Rows ``(key, cell)`` by brute-force point-in-triangle tests."""
    n = 3**r

    def bound(fn: str, axis: str, add: int, last: int) -> str:
        edge = f"{fn}(a{axis}, m{axis}, c{axis})"
        return f"least(greatest(CAST(floor(({edge} + {add})*{n}/30) AS BIGINT), 0), {last})"

    return f"""
    SELECT DISTINCT {key}, {r * L} + y*{R} + x AS cell FROM (
      SELECT *, (CAST(x AS DOUBLE) + 0.5e0)*30/{n} - 180 AS px,
                (CAST(y AS DOUBLE) + 0.5e0)*30/{n} - 90 AS py
      FROM (SELECT *, unnest(range(yl, yh + 1)) AS y
      FROM (SELECT *, unnest(range(xl, xh + 1)) AS x
      FROM (SELECT *, {bound('least', 'x', 180, 12 * n - 1)} AS xl,
                      {bound('greatest', 'x', 180, 12 * n - 1)} AS xh,
                      {bound('least', 'y', 90, 6 * n - 1)} AS yl,
                      {bound('greatest', 'y', 90, 6 * n - 1)} AS yh
            FROM ({corners}) c0) c1) c2) c3) c4
    WHERE ({crosses('a', 'm')} + {crosses('m', 'c')} + {crosses('c', 'a')}) % 2 = 1
    """


def fact_cells(facts: str, corners: str, r: int, key: str = "id") -> str:
    """Rows ``(key, cell)`` of those cells of facts whose centre lies in a zone."""
    n = 3**r

    return f"""
    SELECT DISTINCT z.{key}, f.cell FROM (
      SELECT DISTINCT cell, (CAST(cell & {LOW} AS DOUBLE) + 0.5e0)*30/{n} - 180 AS px,
             (CAST((cell >> 28) & {LOW} AS DOUBLE) + 0.5e0)*30/{n} - 90 AS py FROM ({facts}) f0) f
    JOIN ({corners}) z
    ON ({crosses('a', 'm')} + {crosses('m', 'c')} + {crosses('c', 'a')}) % 2 = 1
    """


def sql(name: str) -> str:
    return t.duck(getattr(t, name))


def occurrences(r: int, ranks: bool = False) -> str:
    base = f"SELECT taxonkey, {cell('lng', 'lat', r)} AS cell FROM ({sql('OCCURRENCES')}) o"
    if not ranks:
        return base
    return f"SELECT o2.cell, o2.taxonkey, x.* EXCLUDE (taxonkey) FROM ({base}) o2 LEFT JOIN ({sql('TAXA')}) x USING (taxonkey)"


def log_value(counts: str, key: str) -> str:
    """Counts with the log scale; ``counts`` has columns ``key, n``."""
    return f"""
    WITH s AS ({counts})
    SELECT {key}, n, round(ln(n), 6) AS logn,
           round(ln(n)/nullif((SELECT max(ln(n)) FROM s), 0), 6) AS value
    FROM s
    """


def hex_richness(
    zones: str, r: int, where: str = "TRUE", ranks: bool = False, area: str | None = None
) -> str:
    return log_value(
        f"""SELECT h3id, count(*) AS n FROM (
              SELECT DISTINCT o.taxonkey, o.cell AS h3id, a.id
              FROM ({occurrences(r, ranks)}) o JOIN ({area or cells(zones, r)}) a ON o.cell = a.cell
              WHERE {where}) d GROUP BY h3id""",
        "h3id",
    )


def zonal_richness(
    zones: str,
    r: int,
    mode: str = "occupancy",
    where: str = "TRUE",
    key: str = "id",
    area: str | None = None,
) -> str:
    columns = "o.taxonkey, o.cell" if mode == "occupancy" else "o.taxonkey"
    return log_value(
        f"""SELECT {key}, count(*) AS n FROM (
              SELECT DISTINCT {columns}, a.{key}
              FROM ({occurrences(r, where != 'TRUE')}) o
              JOIN ({area or cells(zones, r, key)}) a ON o.cell = a.cell
              WHERE {where}) d GROUP BY {key}""",
        key,
    )


def carbon(r: int) -> str:
    return (
        f"SELECT {cell('lng', 'lat', r)} AS cell, Z AS carbon "
        f"FROM ({sql('CARBON_POINTS')}) e WHERE Z IS NOT NULL"
    )


def mean_value(zones: str, fine: int, r: int, key: str, area: str | None = None) -> str:
    return f"""
    WITH s AS (SELECT {'f.cell AS h3id' if key == 'h3id' else 'a.id'}, avg(carbon) AS carbon
               FROM (SELECT {up('cell', fine, r)} AS cell, carbon FROM ({carbon(fine)}) c) f
               JOIN ({area or cells(zones, r)}) a ON f.cell = a.cell GROUP BY 1)
    SELECT {key}, round(carbon + 1e-10, 6) AS carbon,
           round(carbon/nullif((SELECT max(carbon) FROM s), 0) + 1e-10, 6) AS value FROM s
    """


def ranges(fine: int = 2, where: str = "TRUE") -> str:
    return (
        f"SELECT DISTINCT taxon_id, {cell('lng', 'lat', fine)} AS fine FROM ({sql('RANGE_POINTS')}) p "
        f"JOIN ({sql('RANGE_TAXA')}) x ON x.id = p.taxon_id WHERE {where}"
    )


def range_rows(zones: str, r: int, fine: int = 2, where: str = "TRUE") -> str:
    """Joined rows ``h3id, id, taxon_id, fine`` at the finer or coarser area level."""
    if r >= fine:
        on = f"d.fine = {up('a.cell', r, fine)}"
    else:
        on = f"{up('d.fine', fine, r)} = a.cell"
    return (
        f"SELECT a.cell AS h3id, a.id, d.taxon_id, d.fine "
        f"FROM ({ranges(fine, where)}) d JOIN ({cells(zones, r)}) a ON {on}"
    )


def range_stat(rows: str, key: str, distinct: bool = False) -> str:
    what = "count(DISTINCT taxon_id)" if distinct else "count(*)"
    return log_value(f"SELECT {key}, {what} AS n FROM ({rows}) j GROUP BY {key}", key)


RANK_SQL = ", ".join('ordr AS "order"' if r == "order" else r for r in RANKS)
