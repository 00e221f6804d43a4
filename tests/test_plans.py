"""What Spark will run: no Python, no one-task shuffles of facts, few exchanges."""

import pytest
from pyspark.sql import functions as F

from cellzonal.operators import stats
from cellzonal.operators.polyfill import polyfill, run_area
from cellzonal.plans.richness import hex_richness, zonal_richness
from tests.helpers import plan
from workload import tables as t
from workload.queries import QUERIES

ALL = sorted(QUERIES)


@pytest.fixture
def static(spark):
    """Plans as first written, without run-time changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_python_and_no_cross_join_in_any_query(static, sf):
    for name in ALL:
        text = plan(QUERIES[name](static, sf))
        for node in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop"):
            assert node not in text, (name, node)


def test_fill_shuffles_once(static, sf):
    assert plan(polyfill(t.counties(static, sf), 5)).count("Exchange ") == 1


def above(text, mark):
    """What stands above a plan's line that has the mark, nearest first, up to the first join."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*()0123456789"))

    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found.append(line)
            if "SortMergeJoin" in line or "ShuffledHashJoin" in line:
                break
    return found


def test_bucketed_facts_are_never_shuffled(static, sf):
    spark = static
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["bucketed_hex_richness"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    over = above(text, "Bucketed: true")
    assert any("SortMergeJoin" in line for line in over)
    assert any("keys=[taxonkey" in line for line in over)
    assert not any("Exchange" in line for line in over)


def test_runs_are_met_without_ancestors(static, sf):
    aoi = run_area(t.counties(static, sf), 8)
    text = plan(zonal_richness(t.occurrences(static, sf, 8), aoi, 8))
    assert text.count("Generate explode(sequence") >= 1
    assert "Generate explode(array" not in text and "_key" not in text


def test_only_the_maximum_goes_to_one_task(static, sf):
    aoi = polyfill(t.regions(static, sf), 3)
    text = plan(zonal_richness(t.occurrences(static, sf, 3), aoi, 3))
    assert text.count("Exchange SinglePartition") == 1
    before = text.split("Exchange SinglePartition")[1].lstrip().split("\n")[1]
    assert "partial_max" in before


def test_normalising_reuses_the_shuffle(static, sf):
    facts = t.read(static, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    text = plan(stats.log_normalise(facts))
    assert "Window" not in text and "ReusedExchange" in text


def test_duplicates_go_before_the_join(static, sf):
    """The join of counts with the area sits above the aggregate per cell."""
    aoi = polyfill(t.regions(static, sf), 5)
    text = plan(hex_richness(t.occurrences(static, sf, 5), aoi, 5, geometry=False))
    joins = [i for i, line in enumerate(text.splitlines()) if "Join [h5" in line]
    counts = [i for i, line in enumerate(text.splitlines()) if "functions=[count(1)]" in line and "keys=[h5" in line]
    assert joins and counts and joins[0] < counts[0]


def test_scan_reads_only_what_is_asked(static, sf):
    text = plan(t.occurrences(static, sf, 3))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int>" in text


def test_taxon_filter_reaches_the_scan(static, sf):
    text = plan(QUERIES["child_taxa_top"](static, sf))
    assert "EqualTo(p_type,ECONOMY)" in text
