import pytest
from pyspark.sql import functions as F

from cellzonal.operators import layers
from cellzonal.operators.layers import LAYERS, LayerConfig, LayerFilter
from tests.helpers import rows


@pytest.fixture(scope="module")
def tables(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return {
        "country_layer": make([("1", "US", "United"), ("2", "FR", "France")], "id string, country string, primary string"),
        "region_layer": make(
            [("10", "US", "US-CA"), ("11", "US", "US-HI"), ("12", "FR", "FR-A"), ("13", None, None)],
            "id string, country string, region string",
        ),
        "county_layer": make(
            [("20", "US-CA", "Orange"), ("21", "US-HI", "Maui"), ("22", "FR-A", "Orange")],
            "id string, region string, primary string",
        ),
        "tract_layer": make(
            [("F1", "Orange", "CA"), ("F2", "Orange", "FL"), ("F3", "Maui", "HI")],
            "FIPS string, COUNTY string, ST_ABBR string",
        ).withColumn("id", F.col("FIPS")),
        "pad_layer": make([(1, "1"), (2, "4"), (3, None)], "row_n int, GAP_Sts string"),
    }


def one(tables, layer, feature):
    return layers.feature_by_id(tables[layer], feature, LAYERS[layer])


def test_children_of_one_feature(tables):
    regions = layers.child_polygons(one(tables, "country_layer", "1"), "country_layer", tables)
    assert rows(regions, "id") == [("10",), ("11",)]
    counties = layers.child_polygons(one(tables, "region_layer", "10"), "region_layer", tables)
    assert rows(counties, "id") == [("20",)]


def test_counties_match_tracts_by_name_only(tables):
    tracts = layers.child_polygons(one(tables, "county_layer", "20"), "county_layer", tables)
    assert rows(tracts, "FIPS") == [("F1",), ("F2",)]


def test_composite_link(spark, tables):
    parent = spark.createDataFrame([("Orange", "CA")], "primary string, state string")
    config = LayerConfig(
        "c", next_layer="tract_layer", filter_columns=("COUNTY", "ST_ABBR"), filter_properties=("primary", "state")
    )
    assert rows(layers.children_of(parent, tables["tract_layer"], config), "FIPS") == [("F1",)]


def test_guards_return_the_input(tables):
    both, single = tables["country_layer"], one(tables, "country_layer", "1")
    assert layers.child_polygons(both, "country_layer", tables) is both
    for layer in ("no such layer", None, "tract_layer", "none", "current_drawing"):
        assert layers.child_polygons(single, layer, tables) is single


def test_no_parent_has_no_children(tables):
    nobody = one(tables, "country_layer", "9")
    assert layers.child_polygons(nobody, "country_layer", tables).count() == 0


def test_a_layer_may_be_its_own_child(tables):
    area = one(tables, "pad_layer", 2)
    assert rows(layers.child_polygons(area, "pad_layer", tables), "row_n") == [(2,)]


def test_feature_by_id_without_id_column_is_the_whole_layer(tables):
    nameless = tables["pad_layer"]
    assert layers.feature_by_id(nameless, "x", LAYERS["country_layer"]) is nameless


def test_filters(tables):
    pad = tables["pad_layer"]
    assert layers.apply_filter(pad, None) is pad
    assert rows(layers.apply_filter(pad, LayerFilter("row_n", "==", 2)), "row_n") == [(2,)]
    both = [LayerFilter("GAP_Sts", "in", layers.GAP_INITIAL), LayerFilter("row_n", "==", 1)]
    assert rows(layers.apply_filter(pad, both), "row_n") == [(1,)]
    assert layers.apply_filter(pad, LayerFilter("GAP_Sts", "in", ["1", "4"])).count() == 2
    with pytest.raises(ValueError):
        layers.apply_filter(pad, LayerFilter("row_n", "<", 1))


def test_first_non_empty(tables):
    default, some = tables["country_layer"], tables["pad_layer"]
    empty = some.where("row_n < 0")
    assert layers.is_empty(None) and layers.is_empty(empty) and not layers.is_empty(some)
    assert layers.first_non_empty([None, empty, some], default) is some
    assert layers.first_non_empty([None, empty], default) is default


def test_members_and_admin_level(spark, tables):
    wanted = spark.createDataFrame([("Orange",), ("Orange",), (None,)], "name string")
    assert rows(layers.members(tables["county_layer"], "primary", wanted), "id") == [("20",), ("22",)]
    divisions = spark.createDataFrame(
        [(1, "region", True), (2, "region", False), (3, "county", True), (4, "region", None)],
        "id int, subtype string, is_land boolean",
    )
    assert rows(layers.admin_level(divisions, "region"), "id") == [(1,)]
