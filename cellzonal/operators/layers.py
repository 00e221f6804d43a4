"""Administrative layers and feature selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class LayerConfig:
    """How a layer names its features and links to the layer below.

    ``filter_columns`` of the child must equal ``filter_properties`` of the
    parent; several pairs make a composite key.
    """

    name: str
    id_property: str | None = None
    name_property: str | None = None
    parent_layer: str | None = None
    next_layer: str | None = None
    filter_columns: tuple[str, ...] = ()
    filter_properties: tuple[str, ...] = ()
    clear_filter: bool = False


# The layers and their links.
LAYERS: dict[str, LayerConfig] = {
    layer.name: layer
    for layer in (
        LayerConfig(
            "country_layer", "id", "primary", None, "region_layer", ("country",), ("country",), True
        ),
        LayerConfig(
            "region_layer", "id", "primary", "country_layer", "county_layer", ("region",), ("region",)
        ),
        LayerConfig(
            "county_layer", "id", "primary", "region_layer", "tract_layer", ("COUNTY",), ("primary",)
        ),
        LayerConfig("tract_layer", "id", "FIPS", "county_layer"),
        LayerConfig("pad_layer", "row_n", "Unit_Nm", None, "pad_layer", ("row_n",), ("row_n",)),
        LayerConfig("current_drawing"),
        LayerConfig("none", clear_filter=True),
    )
}
# Protection classes shown at first, and those of the drawn layer.
GAP_INITIAL = ("1", "2", "3")
GAP_DRAWN = ("1", "2")


@dataclass(frozen=True)
class LayerFilter:
    """One condition on a layer: ``==`` with a value or ``in`` with several."""

    column: str
    op: str
    value: object

    def predicate(self) -> Column:
        if self.op == "==":
            return F.col(self.column) == F.lit(self.value)
        if self.op == "in":
            return F.col(self.column).isin(*self.value)
        raise ValueError(f"unknown operator {self.op!r}")


def apply_filter(layer: DataFrame, condition: LayerFilter | Sequence[LayerFilter] | None) -> DataFrame:
    """Features meeting all conditions; ``None`` keeps every feature."""
    if condition is None:
        return layer
    several = [condition] if isinstance(condition, LayerFilter) else list(condition)
    return layer.where(reduce(lambda a, b: a & b, [c.predicate() for c in several], F.lit(True)))


def feature_by_id(layer: DataFrame, feature: object, config: LayerConfig) -> DataFrame:
    """The feature with an id; the whole layer when it has no id column."""
    if config.id_property in layer.columns:
        return layer.where(F.col(config.id_property) == F.lit(feature))
    return layer


def is_empty(df: DataFrame | None) -> bool:
    """No table or no rows; looks at one row."""
    return df is None or df.isEmpty()


def first_non_empty(sources: Sequence[DataFrame | None], default: DataFrame) -> DataFrame:
    """The first source with a feature: selection, drawing, place, view."""
    return next((s for s in sources if not is_empty(s)), default)


def members(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value occurs in a one-column table of any size."""
    keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
    return df.join(keys, column, "left_semi")


def children_of(
    parents: DataFrame,
    children: DataFrame,
    parent: LayerConfig,
) -> DataFrame:
    """Child features of any number of parents (J6 without its one-parent guard)."""
    keys = parents.select(
        *[F.col(p).alias(c) for p, c in zip(parent.filter_properties, parent.filter_columns)]
    )
    return children.join(keys, list(parent.filter_columns), "left_semi")


def child_polygons(
    parents: DataFrame,
    layer: str | None,
    tables: Mapping[str, DataFrame],
    layers: Mapping[str, LayerConfig] = LAYERS,
) -> DataFrame:
    """Features one layer below a single feature.

    Returns the input for more than one parent, an unknown layer, or a layer
    with nothing below.
    """
    config = layers.get(layer) if layer is not None else None
    if config is None or config.next_layer is None or parents.limit(2).count() > 1:
        return parents
    return children_of(parents, tables[config.next_layer], config)


def admin_level(divisions: DataFrame, subtype: str) -> DataFrame:
    """Land areas of one administrative level."""
    return divisions.where((F.col("subtype") == subtype) & F.col("is_land"))
