"""Sets of taxa as lists against sets in plain Python, and what their making shuffles."""

import pytest
from pyspark.sql import functions as F

from cellzonal.operators import bitmaps
from cellzonal.operators.polyfill import compact_fill, polyfill
from cellzonal.plans.richness import zonal_richness
from tests.helpers import pack, plan, rows
from tests.test_bitmaps import LEVEL, areas, facts, records, wanted  # noqa: F401
from workload.queries import QUERIES

BROAD = [None, 0, -1, -(2**20), 2**20 - 1, 2**20, 2**20 + 7, -(2**40), 2**62]


def test_lists_hold_the_taxa_of_every_level(facts, records):  # noqa: F811
    got = bitmaps.listed_sets(facts, LEVEL, 0)
    counted = got.groupBy("cell").agg(F.sum(F.size("positions")), F.sum("pairs"))
    assert sorted(map(tuple, counted.collect())) == sorted(x for k in range(LEVEL + 1) for x in wanted(records, k))


def test_wide_and_negative_ids_come_back(spark):
    seen = [(t, pack(LEVEL, 5, 5)) for t in BROAD] + [(t, pack(LEVEL, 6, 5)) for t in BROAD[:4]] + [(1, None), (0, pack(LEVEL, 5, 5))]
    sets = bitmaps.listed_sets(spark.createDataFrame(seen, f"taxonkey long, h{LEVEL} long"), LEVEL, 2).collect()
    one = {r["cell"]: set() for r in sets}
    for r in sets:
        assert r["positions"] == sorted(set(r["positions"]))
        one[r["cell"]] |= {None} if r["bucket"] is None else {(r["bucket"] << 20) + x for x in r["positions"]}
    assert one == {pack(LEVEL, 5, 5): set(BROAD), pack(LEVEL, 6, 5): set(BROAD[:4]), **{pack(2, x // 3, 1): set(BROAD) for x in (5,)}, pack(2, 2, 1): set(BROAD[:4])}


@pytest.mark.parametrize("mode", ["occupancy", "species"])
def test_zones_equal_those_of_the_facts(facts, areas, mode):  # noqa: F811
    sets, aoi = bitmaps.listed_sets(facts, LEVEL, 1), compact_fill(areas, LEVEL, start=1, step=1)
    got = bitmaps.zonal_richness(sets, aoi, LEVEL, mode=mode, coarsest=1)
    assert rows(got) == rows(zonal_richness(facts, polyfill(areas, LEVEL), LEVEL, mode=mode))


def test_odd_facts(spark):
    schema = f"taxonkey int, h{LEVEL} long"
    assert bitmaps.listed_sets(spark.createDataFrame([], schema), LEVEL, 0).count() == 0
    assert bitmaps.listed_sets(spark.createDataFrame([(1, None), (None, None)], schema), LEVEL, 0).count() == 0
    with pytest.raises(ValueError):
        bitmaps.listed_sets(spark.createDataFrame([("a", 1)], f"taxonkey string, h{LEVEL} long"), LEVEL, 0)


def test_pairs_are_shuffled_twice_and_lists_never(facts):  # noqa: F811
    text = plan(bitmaps.listed_sets(facts, LEVEL, 0))
    assert text.count("Exchange hashpartitioning") == 2
    assert not any("Exchange" in line for line in text.split("collect_set")[0].splitlines())


def test_stored_sets_of_the_queries_have_no_bitmaps(spark, sf):
    for name in ("zonal_species_sets", "zonal_occupancy_sets"):
        assert "taxa#" not in plan(QUERIES[name](spark, sf)) and "bitmap" not in plan(QUERIES[name](spark, sf))
