"""Display columns published with features: recodes, colour ramp, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Protected-area palettes.
MANAGER_COLOURS = {
    "JNT": "#DAB0AE",
    "TERR": "#A1B03D",
    "STAT": "#A1B03D",
    "FED": "#529642",
    "UNK": "#bbbbbb",
    "LOC": "#365591",
    "PVT": "#7A3F1A",
    "DIST": "#0096FF",
    "TRIB": "#BF40BF",
    "NGO": "#D77031",
}
GAP_STATUS_COLOURS = {"1": "#26633d", "2": "#879647", "3": "#bdcf72", "4": "#6d6e6d"}
DEFAULT_COLOUR = "#D3D3D3"

# Seven evenly spaced stops of the viridis palette, two of the flat ramp.
VIRIDIS = ("#440154", "#443A83", "#31688E", "#21908C", "#35B779", "#8FD744", "#FDE725")
GREENS = ("#f0ffe4", "#234b02")

# Fixed value: height of a feature whose value is 1.
EXTRUSION_HEIGHT = 10000


def recode(column: Column, values: dict[str, str], default: str) -> Column:
    """Map known values, everything else (null too) to the default."""
    pairs = [F.lit(v) for pair in values.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def manager_colour(manager_type: Column) -> Column:
    return recode(manager_type, MANAGER_COLOURS, DEFAULT_COLOUR)


def gap_colour(gap_status: Column) -> Column:
    return recode(gap_status, GAP_STATUS_COLOURS, DEFAULT_COLOUR)


def ramp_colour(value: Column, stops: tuple[str, ...] = VIRIDIS) -> Column:
    """Colour on evenly spaced stops over 0..1, linear in between."""
    last = len(stops) - 1
    scaled = F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * float(last)
    segment = F.least(F.floor(scaled), F.lit(last - 1)).cast("int")

    def channel(offset: int) -> Column:
        levels = [int(s[offset : offset + 2], 16) for s in stops]
        table = F.array(*[F.lit(float(v)) for v in levels])
        low, high = F.get(table, segment), F.get(table, segment + 1)
        return F.floor(low + (high - low) * (scaled - segment) + 0.5)

    return F.when(
        value.isNotNull(), F.format_string("#%02x%02x%02x", channel(1), channel(3), channel(5))
    )


def extrusion_height(value: Column) -> Column:
    """Height of an extruded feature in metres (X11)."""
    return value * EXTRUSION_HEIGHT


def label(fields: dict[str, Column], separator: str = "<br>") -> Column:
    """Tooltip text ``Name: value`` per field; missing values print empty."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.coalesce(column.cast("string"), F.lit("")))
        for name, column in fields.items()
    ]
    return reduce(lambda a, b: F.concat(a, F.lit(separator), b), lines)
