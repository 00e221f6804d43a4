"""Stored sets of taxa against sets in plain Python, and parts kept per base cell."""

import random

import pytest
from pyspark.sql import functions as F

from cellzonal.functions import grid
from cellzonal.operators import bitmaps, cache
from cellzonal.operators.polyfill import compact_fill, polyfill, run_area
from cellzonal.plans import prepare
from cellzonal.plans.richness import hex_richness, zonal_richness
from cellzonal.sources.tables import open_cells
from tests.helpers import pack, plan, rows, square_zone, zones

LEVEL = 3


def parent(cell, to_level):
    step = 3 ** ((cell >> 56) - to_level)
    return pack(to_level, (cell & ((1 << 28) - 1)) // step, ((cell >> 28) & ((1 << 28) - 1)) // step)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    # Ids beyond one bucket, below zero, and none; a third of all rows in one cell.
    ids = [None, 0, -1, -40_000, 5, 32_768, 32_769, 2_000_000_000_000, *range(100, 140)]
    found = [(rng.choice(ids), pack(LEVEL, rng.randrange(100, 200), rng.randrange(50, 110))) for _ in range(3000)]
    return found + [(rng.choice(ids), pack(LEVEL, 150, 80)) for _ in range(1500)]


@pytest.fixture(scope="module")
def facts(spark, records):
    return spark.createDataFrame(records, f"taxonkey long, h{LEVEL} long").cache()


@pytest.fixture(scope="module")
def areas(spark):
    shapes = [("a", square_zone(-65, -40, 40.2, 30.1)), ("b", square_zone(-20.3, -30.2, 10.1, 20.3)), ("c", square_zone(160, 60, 170, 70))]
    return zones(spark, shapes)


def counted(sets):
    got = sets.groupBy("cell").agg(F.sum(F.bitmap_count("taxa")), F.sum("pairs"))
    return sorted(map(tuple, got.collect()))


def wanted(records, level):
    taxa, pairs = {}, {}
    for taxon, cell in records:
        up = parent(cell, level)
        taxa.setdefault(up, set()).add(taxon)
        pairs.setdefault(up, set()).add((taxon, cell))
    return sorted((c, len(taxa[c]), len(pairs[c])) for c in taxa)


def test_sets_hold_the_taxa_of_their_cell(facts, records):
    assert counted(bitmaps.taxa_sets(facts, LEVEL)) == wanted(records, LEVEL)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_roll_up_counts_each_taxon_once(facts, records, level):
    sets = bitmaps.taxa_sets(facts, LEVEL)
    assert counted(bitmaps.roll_up(sets, LEVEL, level)) == wanted(records, level)


def test_all_levels_at_once(facts, records):
    whole = bitmaps.with_coarser(bitmaps.taxa_sets(facts, LEVEL), LEVEL, 0)
    assert counted(whole) == sorted(row for k in range(LEVEL + 1) for row in wanted(records, k))


def test_merge_of_overlapping_deliveries(spark, records):
    schema = f"taxonkey long, h{LEVEL} long"
    old, new = spark.createDataFrame(records[:3000], schema), spark.createDataFrame(records[2000:], schema)
    merged = bitmaps.merge(bitmaps.taxa_sets(old, LEVEL), bitmaps.taxa_sets(new, LEVEL))
    assert counted(merged) == wanted(records, LEVEL)


@pytest.mark.parametrize("mode", ["occupancy", "species"])
@pytest.mark.parametrize("kind", ["plain", "compact", "coarse"])
def test_zones_equal_those_of_the_facts(facts, areas, mode, kind):
    sets = bitmaps.taxa_sets(facts, LEVEL)
    plain = polyfill(areas, LEVEL)
    expected = rows(zonal_richness(facts, plain, LEVEL, mode=mode))
    if kind == "plain":
        got = bitmaps.zonal_richness(sets, plain, LEVEL, mode=mode)
    else:
        # Blocks coarser than the stored sets are cut.
        coarsest = 2 if kind == "coarse" else 0
        aoi = compact_fill(areas, LEVEL, start=0, step=1)
        assert aoi.where(f"shiftright(cell, 56) < {LEVEL}").count() > 0
        whole = bitmaps.with_coarser(sets, LEVEL, coarsest)
        got = bitmaps.zonal_richness(whole, aoi, LEVEL, mode=mode, coarsest=coarsest)
    assert rows(got) == expected


def test_cells_of_overlapping_zones_count_once_per_zone(facts, areas):
    plain = polyfill(areas, LEVEL)
    got = bitmaps.hex_richness(bitmaps.taxa_sets(facts, LEVEL), plain, LEVEL)
    assert rows(got) == rows(hex_richness(facts, plain, LEVEL, geometry=False))


def test_stored_sets_read_back(spark, facts, records, tmp_path):
    sets = bitmaps.by_base_cell(bitmaps.with_coarser(bitmaps.taxa_sets(facts, LEVEL), LEVEL, 1))
    prepare.write_compact(sets, str(tmp_path / "sets"))
    stored = open_cells(spark, str(tmp_path / "sets"))
    assert counted(stored) == sorted(row for k in (1, 2, 3) for row in wanted(records, k))
    assert "PartitionFilters: [isnotnull(h0" in plan(stored.where("h0 = 5")).replace("cast(", "").replace("(cast", "")


def test_odd_input(spark, areas):
    schema = f"taxonkey int, h{LEVEL} long, cell string, taxa string"
    empty = spark.createDataFrame([], schema)
    assert bitmaps.taxa_sets(empty, LEVEL).count() == 0
    nowhere = spark.createDataFrame([(1, None, "x", "y"), (None, None, None, None)], schema)
    assert bitmaps.taxa_sets(nowhere, LEVEL).count() == 0
    nameless = spark.createDataFrame([(None, pack(LEVEL, 1, 1), "x", "y")] * 3, schema)
    assert counted(bitmaps.taxa_sets(nameless, LEVEL)) == [(pack(LEVEL, 1, 1), 1, 1)]
    with pytest.raises(ValueError):
        bitmaps.taxa_sets(spark.createDataFrame([("a", 1)], f"taxonkey string, h{LEVEL} long"), LEVEL)
    sets = bitmaps.taxa_sets(nameless, LEVEL)
    with pytest.raises(ValueError):
        bitmaps.zonal_richness(sets, run_area(areas, LEVEL), LEVEL)
    with pytest.raises(ValueError):
        bitmaps.zonal_richness(sets, compact_fill(areas, LEVEL), LEVEL)
    assert bitmaps.zonal_richness(sets, polyfill(areas, LEVEL), LEVEL).count() == 0


# -- parts kept per base cell ----------------------------------------------------------


class Counting:
    """A result per base cell that remembers which base cells were computed."""

    def __init__(self):
        self.asked = []

    def __call__(self, facts):
        self.asked.append(facts)
        return facts.groupBy("h0").agg(F.sum("v").alias("total"))

    def computed(self):
        """Base cells of the last call that was more than the look at its columns."""
        return sorted(r[0] for r in self.asked[-1].select("h0").distinct().collect())


def given(spark, values, kind="long"):
    return spark.createDataFrame(values, f"h0 {kind}, v long")


def test_only_changed_base_cells_are_computed_again(spark, tmp_path):
    root = str(tmp_path)
    old = [(1, 10), (1, 20), (2, 5), (3, 7), (3, 7)]
    first = Counting()
    got = cache.cached_by_part(given(spark, old), "t", {}, first, root)
    assert rows(got) == [(1, 30), (2, 5), (3, 14)] and first.computed() == [1, 2, 3]
    files = {f for f in tmp_path.rglob("*.parquet")}

    again = Counting()
    got = cache.cached_by_part(given(spark, old[::-1]), "t", {}, again, root)
    assert rows(got) == [(1, 30), (2, 5), (3, 14)] and len(again.asked) == 1
    assert {f for f in tmp_path.rglob("*.parquet")} == files

    changed = Counting()
    new = [(1, 10), (1, 20), (2, 6), (3, 7), (4, 1), (None, 9)]
    got = cache.cached_by_part(given(spark, new), "t", {}, changed, root)
    assert rows(got) == [(1, 30), (2, 6), (3, 7), (4, 1)] and changed.computed() == [2, 3, 4]

    # What was true before is still there.
    back = Counting()
    got = cache.cached_by_part(given(spark, old), "t", {}, back, root)
    assert rows(got) == [(1, 30), (2, 5), (3, 14)] and len(back.asked) == 1


def test_parts_of_unfinished_runs_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    cache.cached_by_part(given(spark, [(1, 1)]), "t", {}, Counting(), root)
    for mark in tmp_path.rglob("_SUCCESS"):
        mark.rename(mark.with_name("lost"))
    once = Counting()
    assert rows(cache.cached_by_part(given(spark, [(1, 1)]), "t", {}, once, root)) == [(1, 1)]
    assert once.computed() == [1]


def test_text_base_cells_and_parameters(spark, tmp_path):
    root = str(tmp_path)
    facts = given(spark, [("1e5", 1), ("100000", 2), ("ab", 3)], "string")
    got = cache.cached_by_part(facts, "t", {"k": 1}, Counting(), root)
    assert rows(got) == [("100000", 2), ("1e5", 1), ("ab", 3)]
    other = Counting()
    cache.cached_by_part(facts, "t", {"k": 2}, other, root)
    assert len(other.asked) == 2
    assert cache.cached_by_part(facts.limit(0), "t", {"k": 1}, Counting(), root).count() == 0
    with pytest.raises(ValueError):
        cache.cached_by_part(facts, "t", {}, lambda f: f.select("v"), root)
