"""Counting rules, one test per trap, and the joins under skew."""

import math
import random
from collections import Counter
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from cellzonal.functions import grid
from cellzonal.operators import joins, stats
from cellzonal.operators.polyfill import compact_fill, polyfill
from cellzonal.plans.carbon import hex_carbon, zonal_carbon
from cellzonal.plans.ranges import detail_table, open_area, range_hex_richness, range_zonal_richness
from cellzonal.plans.richness import hex_richness, species_table, zonal_richness
from cellzonal.session import kept
from tests.helpers import pack, plan, rows, square_zone, zones

RANK_SCHEMA = "kingdom string, phylum string, class string, `order` string, family string, genus string, species string"


@pytest.fixture(params=["broadcast", "shuffled"])
def size(request, spark, monkeypatch):
    """Run with the area broadcast, and with every table too large for that."""
    if request.param == "shuffled":
        monkeypatch.setattr(joins, "BROADCAST_CELLS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def area(spark, pairs, level=2):
    df = spark.createDataFrame(pairs, f"h{level} long, id string")
    return df.select(grid.parent(f"h{level}", level, 0).alias("h0"), f"h{level}", "id")


C = [pack(2, x, 3) for x in range(6)]


@pytest.fixture
def aoi(spark):
    """Cell 2 lies in both zones; zone c meets no record."""
    return area(spark, [(C[0], "a"), (C[1], "a"), (C[2], "a"), (C[2], "b"), (C[3], "b"), (C[5], "c")])


@pytest.fixture
def sightings(spark):
    data = [(1, C[0]), (1, C[0]), (1, C[1]), (2, C[1]), (None, C[1]), (None, C[1])]
    data += [(7, C[2]), (8, C[2]), (1, C[3]), (9, C[4])]
    return spark.createDataFrame(data, "taxonkey long, h2 long")


def test_occupancy_counts_taxon_cell_pairs(size, sightings, aoi):
    got = zonal_richness(sightings, aoi, 2)
    assert rows(got, "id", "n") == [("a", 6), ("b", 3)]
    values = {r["id"]: r for r in got.collect()}
    assert math.isclose(values["b"]["value"], math.log(3) / math.log(6))
    assert math.isclose(values["a"]["logn"], math.log(6))


def test_species_counts_taxa_and_null_is_one_taxon(size, sightings, aoi):
    got = zonal_richness(sightings, aoi, 2, mode="species")
    assert rows(got, "id", "n") == [("a", 5), ("b", 3)]


def test_unknown_mode(sightings, aoi):
    with pytest.raises(ValueError):
        zonal_richness(sightings, aoi, 2, mode="other")


def test_cell_in_two_zones_counts_twice(size, sightings, aoi):
    got = hex_richness(sightings, aoi, 2, geometry=False)
    assert rows(got, "h3id", "n") == sorted([(C[0], 1), (C[1], 3), (C[2], 4), (C[3], 1)], key=repr)


def test_single_counts_have_no_value(spark, aoi):
    one = spark.createDataFrame([(1, C[0])], "taxonkey long, h2 long")
    row = zonal_richness(one, aoi, 2).first()
    assert (row["n"], row["logn"], row["value"]) == (1, 0.0, None)


def test_zones_without_data(spark, sightings, aoi):
    shapes = zones(spark, [(i, square_zone(0, 0, 1, 1)) for i in "abc"])
    assert rows(zonal_richness(sightings, aoi, 2, zones=shapes), "id", "n") == [("a", 6), ("b", 3)]
    kept = zonal_richness(sightings, aoi, 2, zones=shapes, keep_empty=True)
    assert rows(kept, "id", "n") == [("a", 6), ("b", 3), ("c", None)]
    assert kept.columns == ["id", "n", "logn", "value", "geom"]


def test_id_column_must_exist(sightings, aoi):
    with pytest.raises(ValueError, match="FIPS"):
        zonal_richness(sightings, aoi, 2, id_column="FIPS")


def test_cell_column_must_exist(sightings, aoi):
    with pytest.raises(ValueError, match="h9"):
        zonal_richness(sightings, aoi, 9)


def test_species_table_counts_cells_per_taxon(size, spark, aoi):
    data = [("K", None, None, None, None, None, "s1", 1, C[0])] * 3
    data += [("K", None, None, None, None, None, "s1", 1, C[2])]
    data += [("K", "P", None, None, None, None, "s2", 2, C[4])]
    facts = spark.createDataFrame(data, f"{RANK_SCHEMA}, taxonkey long, h2 long")
    got = species_table(facts, aoi, 2)
    assert rows(got, "kingdom", "species", "taxonkey", "n") == [("K", "s1", 1, 3)]
    assert stats.most_common(got, 1).count() == 1


def test_mean_is_over_rows_and_skips_null(size, spark, aoi):
    data = [(10.0, C[0]), (20.0, C[0]), (None, C[0]), (60.0, C[1]), (None, C[3]), (5.0, C[4])]
    facts = spark.createDataFrame(data, "carbon double, h2 long")
    assert rows(hex_carbon(facts, aoi, 2, geometry=False), "h3id", "carbon", "value") == sorted(
        [(C[0], 15.0, 0.25), (C[1], 60.0, 1.0), (C[3], None, None)], key=repr
    )
    assert rows(zonal_carbon(facts, aoi, 2), "id", "carbon", "value") == [
        ("a", 30.0, 1.0), ("b", None, None),
    ]


# -- range maps ---------------------------------------------------------------------


@pytest.fixture
def ranges(spark):
    """Taxon 1 fills three level-2 cells of one level-1 cell, taxon 2 one of them."""
    cells = [pack(2, 0, 0), pack(2, 1, 0), pack(2, 2, 2)]
    data = [(1, c) for c in cells] + [(2, cells[0])]
    df = spark.createDataFrame(data, "taxon_id long, h2 long")
    return df.withColumn("h1", grid.parent("h2", 2, 1)).withColumn("h0", grid.parent("h2", 2, 0))


def test_range_rows_count_unless_distinct(size, spark, ranges):
    aoi = area(spark, [(pack(1, 0, 0), "a")], 1)
    assert rows(range_hex_richness(ranges, aoi, geometry=False), "n") == [(4,)]
    assert rows(range_hex_richness(ranges, aoi, distinct=True, geometry=False), "n") == [(2,)]
    assert rows(range_zonal_richness(ranges, aoi), "id", "n") == [("a", 4)]
    assert rows(range_zonal_richness(ranges, aoi, distinct=True), "id", "n") == [("a", 2)]


def test_data_rolls_up_to_a_coarser_area(size, spark, ranges):
    aoi = area(spark, [(pack(1, 0, 0), "a")], 1)
    only = ranges.select("taxon_id", "h2")
    assert rows(range_hex_richness(only, aoi, geometry=False), "n") == [(4,)]


def test_finer_area_meets_coarse_data_and_reports_its_own_cells(size, spark, ranges):
    fine = [pack(3, 0, 0), pack(3, 1, 1), pack(3, 3, 0), pack(3, 30, 0)]
    aoi = area(spark, [(c, "a") for c in fine] + [(fine[0], "b")], 3)
    got = range_hex_richness(ranges, aoi, geometry=False)
    assert rows(got, "h3id", "n") == sorted([(fine[0], 4), (fine[1], 2), (fine[2], 1)], key=repr)
    assert rows(range_zonal_richness(ranges, aoi), "id", "n") == [("a", 5), ("b", 2)]
    detail = open_area(ranges, aoi)
    assert detail.columns == ["h3id", "id", "taxon_id", "h2", "h1", "h0"]
    assert detail.count() == 7
    assert detail_table(ranges, aoi, rows=3).count() == 3


def test_taxon_selection_goes_through_the_taxonomy(size, spark, ranges):
    taxonomy = spark.createDataFrame([(1, "A"), (2, "B")], "id long, kingdom string")
    aoi = area(spark, [(pack(1, 0, 0), "a")], 1)
    got = range_zonal_richness(ranges, aoi, taxonomy=taxonomy, taxa={"kingdom": "B"})
    assert rows(got, "id", "n") == [("a", 1)]
    with pytest.raises(ValueError):
        range_zonal_richness(ranges, aoi, taxa={"kingdom": "B"})


# -- joins --------------------------------------------------------------------------


def test_copies_of_a_hot_row_are_spread(spark):
    """Two fifths of the rows are one row; run-time splitting deals them to many tasks."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    }
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        key = F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id"))
        left = spark.range(0, 40_000, 1, 16).select(key.alias("k"), F.lit("copy").alias("v"))
        right = spark.range(40_000).select(F.col("id").alias("k"), F.lit("z").alias("zone"))
        joined = joins.join_few(left, right, ["k"]).where("k = 0")
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 16_000 and len(per_task) >= 3 and max(per_task) < 8_000
    finally:
        for key in small:
            spark.conf.unset(key)


def test_joining_starts_no_job(spark, sightings, aoi):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    joins.cell_join(sightings, aoi, 2)
    zonal_richness(sightings, aoi, 2, mode="species")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_id_of_the_facts_is_an_error(spark, sightings, aoi):
    with pytest.raises(ValueError, match="id"):
        joins.cell_join(sightings.withColumn("id", F.lit(1)), aoi, 2)
    with pytest.raises(ValueError, match="id"):
        joins.hex_join(sightings.withColumn("id", F.lit(1)), aoi)


def test_zonal_richness_at_base_level(spark):
    base = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "h0 long, id string")
    facts = spark.createDataFrame([(1, 5), (2, 5), (1, 6), (1, 8)], "taxonkey long, h0 long")
    assert rows(zonal_richness(facts, base, 0), "id", "n") == [("a", 3)]


def test_cell_join_keeps_facts_columns(size, spark, sightings, aoi):
    facts = sightings.withColumn("h0", grid.parent("h2", 2, 0))
    got = joins.cell_join(facts, aoi, 2)
    assert Counter(r["id"] for r in got.collect()) == {"a": 8, "b": 3}
    assert sorted(got.columns) == ["h0", "h2", "id", "taxonkey"]


def test_pruning_by_ancestor_is_a_cover(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_CELLS", 700)
    assert joins.broadcast_level(8) == 1
    aoi = area(spark, [(pack(3, 0, 0), "a")], 3)
    facts = spark.createDataFrame([(pack(3, x, 0),) for x in (0, 8, 9, 300)], "h3 long")
    assert rows(joins.prune_to_cells(facts, aoi, 3)) == [(pack(3, 0, 0),), (pack(3, 8, 0),)]


def test_default_broadcast_levels():
    assert joins.broadcast_level(3) == 3
    assert joins.broadcast_level(9) == 4


# -- summaries ------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
@pytest.mark.parametrize("window", [100_000, 50])
def test_exact_percentile(spark, share, window):
    rng = random.Random(11)
    values = [7.0 if rng.random() < 0.3 else round(rng.uniform(0, 1000), 3) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    wanted = sorted(values)[max(1, math.ceil(round(share * len(values), 6))) - 1]
    assert stats.exact_percentile(df, "v", share, window) == wanted


def test_percentile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert stats.exact_percentile(df, "v", 0.5) is None
    assert stats.above_percentile(df, "v", 0.5).count() == 0


def test_latency_of_one_call_has_no_spread(spark):
    calls = spark.createDataFrame(
        [("a", 2.0, True), ("a", 4.0, True), ("a", 9.0, False), ("b", 1.0, True), ("c", 1.0, False)],
        "m string, s double, ok boolean",
    )
    got = {r["m"]: tuple(r)[1:] for r in stats.latency_summary(calls, "m", F.col("s"), F.col("ok")).collect()}
    assert got["a"][:2] == (3, 2) and got["a"][3] == 3.0 and math.isclose(got["a"][4], math.sqrt(2))
    assert got["b"] == (1, 1, 100.0, 1.0, 0.0)
    assert got["c"] == (1, 0, 0.0, None, 0.0)


def test_compact_area_gives_the_same_statistics(size, spark):
    rng = random.Random(4)
    points = [(rng.randint(1, 30), rng.uniform(-40, 40), rng.uniform(-40, 40), float(i)) for i in range(2000)]
    # Along the edge of one zone within the other, where blocks of two levels hold a cell.
    points += [(i % 9, rng.uniform(1.1, 8.0), rng.uniform(2.0, 2.5), float(i)) for i in range(200)]
    facts = spark.createDataFrame(points, "taxonkey long, lng double, lat double, carbon double").select(
        "taxonkey", "carbon", grid.cell_at("lng", "lat", 6).alias("h6"),
        *[F.lit("x").alias(r) for r in ("kingdom", "phylum", "class", "order", "family", "genus", "species")],
    )
    shapes = {"a": (-9.97, -11.03, 8.01, 14.9), "b": (1.03, 2.05, 29.3, 25.1), "c": (-33.0, -30.0, -32.9, -29.9)}
    df = zones(spark, [(k, square_zone(*b)) for k, b in shapes.items()])
    plain, compact = polyfill(df, 6), compact_fill(df, 6)
    assert compact.count() < plain.count() / 5
    left, right, keys = joins.area_keys(facts.select("h6").distinct(), compact, 6)
    met = left.join(right, keys).groupBy("h6").agg(F.countDistinct("_key").alias("levels"))
    assert met.where("levels > 1").count() > 0
    for statistic in (
        lambda aoi: zonal_richness(facts, aoi, 6).select("id", "n"),
        lambda aoi: zonal_richness(facts, aoi, 6, mode="species").select("id", "n"),
        lambda aoi: hex_richness(facts, aoi, 6, geometry=False).select("h3id", "n"),
        lambda aoi: hex_carbon(facts, aoi, 6, geometry=False).select("h3id", F.round("carbon", 6)),
        lambda aoi: zonal_carbon(facts, aoi, 6).select("id", F.round("carbon", 6)),
        lambda aoi: species_table(facts, aoi, 6),
    ):
        got = rows(statistic(compact))
        assert got == rows(statistic(plain)) and got


def test_pipeline_end_to_end_at_fine_level(spark):
    """Level 6 needs the coarse cover and then the exact join."""
    rng = random.Random(2)
    points = [(i % 40, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(3000)]
    facts = spark.createDataFrame(points, "taxonkey long, lng double, lat double").select(
        "taxonkey", grid.cell_at("lng", "lat", 6).alias("h6")
    )
    shapes = {"a": (-9.97, -11.03, 8.01, 14.9), "b": (1.03, 2.05, 29.3, 25.1)}
    aoi = polyfill(zones(spark, [(k, square_zone(*b)) for k, b in shapes.items()]), 6)
    n = 3**6

    def cell(x, y):
        return int((x + 180) * n // 30), int((y + 90) * n // 30)

    wanted = []
    for k, (x0, y0, x1, y1) in shapes.items():
        seen = set()
        for taxon, x, y in points:
            cx, cy = cell(x, y)
            mx, my = (cx + 0.5) * 30 / n - 180, (cy + 0.5) * 30 / n - 90
            if x0 <= mx < x1 and y0 <= my < y1:
                seen.add((taxon, cx, cy))
        wanted.append((k, len(seen)))
    assert rows(zonal_richness(facts, aoi, 6), "id", "n") == wanted


def test_percentile_keeps_whole_numbers_beyond_doubles(spark):
    first = 2**53
    df = spark.range(first, first + 10).select(F.col("id").alias("v"))
    assert stats.exact_percentile(df, "v", 0.6) == first + 5
    spaced = spark.range(first + 1, first + 1001, 10).select(F.col("id").alias("v"))
    assert stats.exact_percentile(spaced, "v", 0.6, window=5) == first + 591
    assert stats.exact_percentile(df, "v", 0.6, window=2) == first + 5


def _nearest_rank(values, share):
    return sorted(values)[max(1, math.ceil(round(share * len(values), 9))) - 1]


@pytest.mark.parametrize("window", [4096])
@pytest.mark.parametrize("kind", ["double", "float", "int", "long", "decimal(38,10)", "decimal(38,0)", "decimal(9,4)"])
def test_percentiles_of_every_number_type(spark, kind, window):
    rng = random.Random(kind)
    ends = {"int": [-(2**31), 2**31 - 1, 0], "long": [-(2**63), 2**63 - 1, 0, 2**53, 2**53 + 1]}.get(kind)
    if kind in ("double", "float"):
        top = 1.7976931348623157e308 if kind == "double" else 3.4028234663852886e38
        # Powers of two and their neighbours, the smallest numbers, and what is no number.
        reach = range(-1022, 1023, 41) if kind == "double" else range(-126, 127, 9)
        ends = [math.nextafter(2.0**e, d) if kind == "double" else 2.0**e for e in reach for d in (0, math.inf)]
        ends += [-x for x in ends] + [0.0, -0.0, top, -top, math.inf, -math.inf]
        ends += [5e-324, -5e-324, 2.0**-1030] if kind == "double" else [2.0**-149, -(2.0**-140)]
    elif ends is None:
        digits, places = map(int, kind[8:-1].split(","))
        most = 10**digits - 1
        whole = [most, -most, 0, 1, -1] + [rng.randint(-most, most) // 10 ** rng.randint(0, digits - 1) for _ in range(60)]
        ends = [Decimal(n).scaleb(-places, Context(prec=60)) for n in whole]
    else:
        ends = ends + [rng.choice(ends[:2]) // 2 ** rng.randint(1, 30) + rng.randint(-9, 9) for _ in range(60)]
    ends = ends + ends[: len(ends) // 3]
    rng.shuffle(ends)
    df = spark.createDataFrame([(v,) for v in ends + [None]], f"v {kind}")
    shares = [0.0, 0.07, 0.25, 0.5, 0.77, 0.93, 1.0]
    got = {r["share"]: r for r in stats.exact_percentiles(df, "v", shares, window=window).collect()}
    assert {r["n"] for r in got.values()} == {len(ends)}
    assert {s: got[s]["value"] for s in shares} == {s: _nearest_rank(ends, s) for s in shares}


def test_doubles_keep_their_order_in_classes(spark):
    values = [2.0**e for e in range(-1074, 1024)]
    values = sorted({w for v in values for w in (v, math.nextafter(v, 0), math.nextafter(v, math.inf))} | {math.inf})
    values = [-v for v in reversed(values) if v] + values + [math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    classes = [r[0] for r in df.select(stats._magnitude(F.col("v")), "i").orderBy("i").collect()]
    assert all(a <= b for a, b in zip(classes, classes[1:])) and len(set(classes)) > 3900
    assert classes[-1] > classes[-2] > classes[-3] and classes[0] < classes[1]


def test_percentiles_by_group(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 3), rng.uniform(-5, 5)) for _ in range(4000)]
    data += [("c", 1, None), ("d", 1, math.nan), ("d", 1, 1.0), ("e", 2, 7.0)] + [("f", 0, 2.5)] * 50
    df = spark.createDataFrame(data, "g string, h int, v double")
    got = stats.exact_percentiles(df, "v", [0.1, 0.5], ["g", "h"], window=64)
    assert got.columns == ["g", "h", "share", "value", "n"]
    groups = {}
    for g, h, v in data:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    groups[("d", 1)] = [1.0, math.nan]
    found = {(r["g"], r["h"], r["share"]): (r["value"], r["n"]) for r in got.collect()}
    assert len(found) == 2 * len(groups)
    for (g, h), vs in groups.items():
        for s in (0.1, 0.5):
            wanted = 1.0 if g == "d" else _nearest_rank(vs, s)
            assert found[(g, h, s)] == (wanted, len(vs))


def test_percentiles_of_times(spark):
    df = spark.sql(
        "SELECT id, date_add(DATE'1960-02-28', CAST(id * 37 % 1000 AS INT)) AS d, "
        "timestamp_micros(id * 7919000013 - 5000000000000) AS t, "
        "CAST(timestamp_micros(id * 7919000013 - 5000000000000) AS TIMESTAMP_NTZ) AS z, "
        "make_dt_interval(CAST(id % 50 AS INT), 0, 0, CAST(id AS DECIMAL(18, 6)) / 7) AS i, "
        "make_ym_interval(CAST(id % 13 AS INT) - 5, CAST(id % 7 AS INT)) AS m FROM range(1000)"
    )
    for c in "dtzim":
        found = stats.exact_percentiles(df, c, [0.3], window=100)
        ranked = df.selectExpr(f"{c} AS v", f"row_number() OVER (ORDER BY {c}) AS r").where("r = 300")
        if c == "m":
            # Python has no interval of months, so Spark compares them.
            assert found.join(ranked, F.expr("value = v")).count() == 1
        else:
            assert found.first()["value"] == ranked.first()["v"], c


def test_percentiles_shuffle_counts_only(spark, tmp_path):
    spark.range(50_000).selectExpr("id % 3 AS g", "id * 31 % 50000 AS v").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    chosen = stats.exact_percentiles(df, "v", [0.5], ["g"], window=256)
    assert {r["g"]: (r["value"], r["n"]) for r in chosen.collect()} == {
        g: (sorted(i * 31 % 50000 for i in range(g, 50_000, 3))[math.ceil(n / 2) - 1], n)
        for g, n in ((0, 16667), (1, 16667), (2, 16666))
    }
    state = chosen.selectExpr("g AS _g0", "share AS _share", "n AS _rank", "n AS _n", "value AS _low", "value AS _high")
    values = df.selectExpr("g AS _g0", "v AS _v", "v AS _k")
    text = plan(stats._within(values, kept(state), ["_g0"]))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_percentile_of_what_has_no_order_of_bits(spark):
    with pytest.raises(TypeError):
        stats.exact_percentile(spark.createDataFrame([("a",)], "v string"), "v", 0.5)
