"""Sources, sinks, stored results and preparation jobs."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from cellzonal.functions import geometry as geo, grid, style
from cellzonal.operators import cache, publish
from cellzonal.operators.grids import DictionaryGrid, NativeGrid
from cellzonal.operators.polyfill import base_grid, polyfill
from cellzonal.plans import prepare
from cellzonal.session import shared_folder
from cellzonal.sources import features, tables
from tests.helpers import pack, plan, rows, square_zone, zones


@pytest.fixture
def facts(spark):
    return spark.range(2000).select(
        F.col("id").alias("v"),
        grid.cell_at("(id * 37 % 360) - 180", "(id * 17 % 180) - 90", 3).alias("h3"),
    )


@pytest.fixture
def stored(spark, facts, tmp_path):
    root = str(tmp_path / "cells")
    prepare.write_compact(prepare.with_parents(facts, 3, [0, 1, 2]), root, rows_per_file=None)
    return root


def test_one_file_per_base_cell(stored):
    folders = glob.glob(f"{stored}/h0=*")
    assert len(folders) > 20
    assert all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)


def test_crowded_base_cells_are_split(spark, facts, tmp_path):
    crowded = prepare.with_parents(facts, 3, [0]).withColumn("h0", F.lit(1).cast("long"))
    root = str(tmp_path / "crowded")
    prepare.write_compact(crowded, root, rows_per_file=500)
    assert len(glob.glob(f"{root}/h0=1/*.parquet")) >= 4
    assert spark.read.parquet(root).count() == 2000


def test_write_by_base_cell(spark, facts, tmp_path):
    root = str(tmp_path / "plain")
    prepare.write_by_base_cell(prepare.with_parents(facts, 3, [0]), root)
    assert tables.open_cells(spark, root).count() == 2000


def test_region_scan_prunes_folders(spark, stored):
    cells = tables.open_cells(spark, stored)
    assert dict(cells.dtypes)["h0"] == "bigint"
    aoi = polyfill(zones(spark, [("z", square_zone(1, 1, 28, 28))]), 3)
    got = tables.open_region(cells, aoi)
    assert "PartitionFilters: [" in plan(got) and "PartitionFilters: []" not in plan(got)
    assert len(got.select(F.input_file_name()).distinct().collect()) == 1
    near = cells.where(f"h0 = {pack(0, 6, 3)}")
    assert rows(got, "v") == rows(near, "v") and near.count() > 0


def test_region_scan_matches_text_ids_of_either_case(spark, tmp_path):
    root = str(tmp_path / "text")
    spark.createDataFrame([("8029FFFF", 1), ("802bffff", 2), ("80aaffff", 3)], "h0 string, v int").write.partitionBy("h0").parquet(root)
    aoi = spark.createDataFrame([("8029ffff",), ("802BFFFF",)], "h0 string")
    got = tables.open_region(tables.open_cells(spark, root, "v int, h0 string"), aoi)
    assert rows(got, "v") == [(1,), (2,)]


def test_partitions_and_files(spark, stored):
    cells = tables.open_cells(spark, stored)
    chosen = [pack(0, 6, 3), pack(0, 7, 3)]
    part = tables.open_partitions(cells, chosen)
    assert {r[0] for r in part.select("h0").distinct().collect()} == set(chosen)
    assert tables.open_partitions(cells, []) is cells
    paths = [f"{stored}/h0={c}" for c in chosen]
    files = tables.open_files(spark, paths, stored)
    assert "h0" in files.columns and files.count() == part.count()
    assert tables.open_table(spark, f"{stored}/*").count() == 2000
    assert tables.any_of(cells, ["h0", "nothing", "h3"]).columns == ["h0", "h3"]
    assert ("h3", "bigint") in tables.columns_of(cells)


def test_object_store_settings():
    conf = tables.bucket_conf("public", "s3.example.org")
    assert conf["spark.hadoop.fs.s3a.bucket.public.endpoint"] == "s3.example.org"
    assert any("Anonymous" in v for v in conf.values())
    assert "spark.hadoop.fs.s3a.bucket.b.secret.key" in tables.bucket_conf("b", "e", "k", "s", False)
    assert tables.public_url("s3://b/k.json", "e.org") == "https://e.org/b/k.json"
    assert tables.public_url("s3://b/k.json", "e.org", "FALSE") == "http://e.org/b/k.json"
    assert tables.protocol("true") == "https"


# -- stored results -----------------------------------------------------------------


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "a int, b string")
    assert cache.fingerprint(df) == cache.fingerprint(df.orderBy(F.desc("a")).repartition(3))
    others = [
        df.distinct(),
        df.unionByName(df),
        df.withColumnRenamed("b", "c"),
        spark.createDataFrame([(None, "1"), (2, "b"), (2, "b")], "a int, b string"),
        df.limit(0),
    ]
    assert len({cache.fingerprint(d) for d in [df, *others]}) == 6


def test_every_parameter_counts():
    key = cache.cache_key("r", ["x"], {"zoom": 5, "taxa": {"a": "b"}})
    assert key == cache.cache_key("r", ["x"], {"taxa": {"a": "b"}, "zoom": 5})
    others = [("q", ["x"], {"zoom": 5, "taxa": {"a": "b"}}), ("r", ["y"], {"zoom": 5, "taxa": {"a": "b"}}),
              ("r", ["x"], {"zoom": 6, "taxa": {"a": "b"}}), ("r", ["x"], {"zoom": 5, "taxa": {}})]
    assert key not in {cache.cache_key(*o) for o in others}


def test_result_is_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        got = cache.cached(spark, "r", ["in"], {"p": 1}, compute, str(tmp_path))
        assert got.count() == 3
    assert len(calls) == 1
    cache.cached(spark, "r", ["in"], {"p": 2}, compute, str(tmp_path))
    assert len(calls) == 2


def test_unfinished_write_is_no_hit(spark, tmp_path):
    entry = f"{tmp_path}/r/{cache.cache_key('r', [], {})}"
    os.makedirs(f"{entry}/run-0dead")
    spark.range(9).write.parquet(f"{entry}/run-1dead")
    os.remove(f"{entry}/run-1dead/_SUCCESS")
    assert not cache.is_cached(spark, entry)
    got = cache.cached(spark, "r", [], {}, lambda: spark.range(3), str(tmp_path))
    assert got.count() == 3 and cache.is_cached(spark, entry)


def test_stored_area_equals_computed(spark, tmp_path):
    df = zones(spark, [("z", square_zone(1, 1, 40, 40))])
    stored = cache.cached_aoi(df, 3, root=str(tmp_path))
    assert rows(stored) == rows(polyfill(df, 3))
    assert rows(cache.cached_aoi(df, 3, root=str(tmp_path))) == rows(stored)
    assert len(os.listdir(f"{tmp_path}/aoi")) == 1
    cache.cached_aoi(df, 2, root=str(tmp_path))
    assert len(os.listdir(f"{tmp_path}/aoi")) == 2
    assert repr(NativeGrid()) == "NativeGrid()"


def test_published_once(spark, tmp_path):
    df = zones(spark, [("z", square_zone(1, 1, 2, 2))]).withColumnRenamed("geometry", "geom")
    calls = []

    def compute():
        calls.append(1)
        return df

    folders = {cache.published(spark, "p", ["in"], {}, compute, str(tmp_path)) for _ in range(2)}
    assert len(calls) == 1 and len(folders) == 1
    assert features.read_geojson(spark, folders.pop(), one_per_line=True).count() == 1


def test_file_fingerprint_sees_a_new_file(spark, tmp_path):
    root = str(tmp_path / "in")
    spark.range(3).write.parquet(root)
    before = cache.files_fingerprint(spark, root)
    assert before == cache.files_fingerprint(spark, root)
    spark.range(1).write.mode("append").parquet(root)
    assert before != cache.files_fingerprint(spark, root)


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


# -- features and publishing -----------------------------------------------------------


def test_geojson_files(spark, tmp_path):
    df = zones(spark, [("a", square_zone(1, 1, 2, 2)), ("b", square_zone(3, 3, 4, 4))])
    df = df.withColumnRenamed("geometry", "geom").withColumn("n", F.lit(None).cast("int"))
    path = str(tmp_path / "geo")
    publish.write_geojson(df, path)
    lines = [json.loads(x) for f in glob.glob(f"{path}/part-*") for x in open(f)]
    assert {x["properties"]["id"] for x in lines} == {"a", "b"}
    assert lines[0]["type"] == "Feature" and "n" in lines[0]["properties"]
    assert lines[0]["geometry"]["type"] == "MultiPolygon"
    back = features.read_geojson(spark, path, one_per_line=True)
    again = back.select(F.col("properties")["id"].alias("id"), F.col("geometry").alias("geom"))
    assert rows(again) == rows(df, "id", "geom")


def test_geojson_document_with_all_kinds(spark, tmp_path):
    ring = [[0, 0], [9, 0], [9, 9], [0, 0]]
    shapes = [("Point", [5, 6]), ("Polygon", [ring, ring]), ("MultiPolygon", [[ring], [ring]])]
    document = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"k": i}, "geometry": {"type": t, "coordinates": c}}
            for i, (t, c) in enumerate(shapes)
        ],
    }
    (tmp_path / "doc.geojson").write_text(json.dumps(document, indent=1))
    got = {r["kind"]: r for r in features.read_geojson(spark, str(tmp_path / "doc.geojson")).collect()}
    assert tuple(got["Point"]["point"]) == (5.0, 6.0) and got["Point"]["geometry"] is None
    assert len(got["Polygon"]["geometry"]) == 1 and len(got["Polygon"]["geometry"][0]) == 2
    assert len(got["MultiPolygon"]["geometry"]) == 2
    assert got["MultiPolygon"]["properties"] == {"k": "2"}


def _parsed(found):
    return sorted(
        (tuple(r[c] if c != "properties" or r[c] is None else tuple(sorted(r[c].items())) for c in found.columns) for r in found.collect()),
        key=repr,
    )


TRICKY = [
    {"type": "FeatureCollection", "name": 'a "features":[ } { \\', "crs": {"type": "name", "properties": {"name": "}{"}},
     "links": [{"href": "x", "more": {"y": [1]}}, {"href": "]"}], "bbox": [1, 2],
     "features": [
         {"type": "Feature", "id": "1", "properties": {"s": '}]{[ \\" } \\\\', "o": {"p": [{"q": 1}]}},
          "geometry": {"type": "Point", "coordinates": [1, 2]}},
         None,
         {"type": "Feature", "properties": None, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]]]}},
         {"properties": {"no": "type"}, "geometry": None},
         {"type": "Feature", "properties": {"é}": "ü{"}, "geometry": {"type": "Point", "coordinates": [3, 4]}}],
     "after": [{"type": "Feature", "properties": {"not": "one"}}], "last": {"a": [{"b": "}"}]}},
    {"type": "FeatureCollection", "features": []},
    {"features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 6]}}], "type": "FeatureCollection"},
    {"type": "Feature", "properties": {"features": [{"a": 1}]}, "geometry": {"type": "Point", "coordinates": [7, 8]}},
    {"type": "Point", "coordinates": [9, 9]},
]


@pytest.mark.parametrize("block", [40, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_documents_cut_anywhere_read_as_whole_ones(spark, tmp_path, block, indent):
    texts = [json.dumps(d, indent=indent, ensure_ascii=False) for d in TRICKY]
    texts += [texts[0] + "\n", '{"type":"Point","coordinates":[1,2]', '{"type":"Poly', "hello", "[]", texts[3] + " \n"]
    for n, text in enumerate(texts):
        (tmp_path / f"d{n}.geojson").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = _parsed(features.read_geojson(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    wanted = features.parse_geojson(spark.read.text(str(tmp_path), wholetext=True), "value")
    assert got == _parsed(wanted)
    assert sum(r[-1] == "not GeoJSON" for r in got) >= 4


def test_a_broken_end_is_told(spark, tmp_path):
    point = '{"type":"Feature","id":"%d","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}'
    (tmp_path / "d.geojson").write_text('{"type":"FeatureCollection","features":[' + point % 1 + "," + (point % 2)[:60])
    got = {r["feature_id"]: r["error"] for r in features.read_geojson(spark, str(tmp_path)).collect()}
    assert got == {"1": None, None: "not GeoJSON"}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.geojson").write_text("")
    assert features.read_geojson(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("tasks", [1, 5])
def test_one_geojson_document_from_many_tasks(spark, tmp_path, tasks):
    df = zones(spark, [(f"z{i:03}", square_zone(i % 50, 1, i % 50 + 1, 2)) for i in range(200)])
    df = df.withColumnRenamed("geometry", "geom").withColumn("n", F.lit(None).cast("int"))
    df = df.orderBy("id") if tasks == 1 else df.repartitionByRange(tasks, "id").sortWithinPartitions("id")
    path = str(tmp_path / "one file.geojson")
    publish.write_geojson_document(df, path)
    document = json.load(open(path))
    assert document["type"] == "FeatureCollection"
    assert [f["properties"]["id"] for f in document["features"]] == [f"z{i:03}" for i in range(200)]
    assert os.listdir(tmp_path) == ["one file.geojson"] or sorted(os.listdir(tmp_path)) == [".one file.geojson.crc", "one file.geojson"]
    back = features.read_geojson(spark, path)
    assert rows(back.select(F.col("properties")["id"].alias("id"), F.col("geometry").alias("geom"))) == rows(df, "id", "geom")
    with pytest.raises(FileExistsError):
        publish.write_geojson_document(df, path)


def test_one_document_of_nothing_and_one_csv(spark, tmp_path):
    none = zones(spark, []).withColumnRenamed("geometry", "geom")
    publish.write_geojson_document(none, str(tmp_path / "none.geojson"))
    assert json.load(open(tmp_path / "none.geojson"))["features"] == []
    df = spark.range(1000).selectExpr("id AS `a,b`", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('x\"', id, ', y') END AS s")
    df = df.repartitionByRange(6, F.col("`a,b`")).sortWithinPartitions("`a,b`")
    publish.write_csv_document(df, str(tmp_path / "t.csv"))
    lines = open(tmp_path / "t.csv").read().splitlines()
    assert len(lines) == 1001 and lines[0] == '"a,b",s' and lines[1] == '0,'
    assert [int(x.split(",")[0]) for x in lines[1:]] == list(range(1000))
    assert rows(spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "t.csv"))) == rows(df)
    publish.write_csv_document(df.limit(0), str(tmp_path / "e.csv"))
    assert open(tmp_path / "e.csv").read() == '"a,b",s\n'


def test_stores_that_cannot_join_files_are_refused(spark, tmp_path, monkeypatch):
    files, place = publish._files(spark, str(tmp_path / "x"))

    class Store:
        def exists(self, _):
            return False

        def hasPathCapability(self, *_):
            return False

    class Place:
        def toUri(self):
            return type("U", (), {"getScheme": lambda self: "bucket"})()

    monkeypatch.setattr(publish, "_files", lambda *_: (Store(), Place()))
    with pytest.raises(ValueError, match="bucket cannot join files"):
        publish.write_csv_document(spark.range(1), "bucket://a/b")


def test_views_are_clamped(spark):
    df = spark.createDataFrame([(1, -190, -95, 185, 91)], "id int, xmin int, ymin int, xmax int, ymax int")
    view = features.views(df)
    assert view.columns == ["id", "geometry"]
    b = view.select(geo.bounds_of(F.col("geometry")).alias("b")).select("b.*").first()
    assert tuple(b) == (-178.0, -89.99, 178.0, 89.99)


def test_plain_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    publish.write_table(df, str(tmp_path / "t"))
    publish.write_csv(df, str(tmp_path / "c"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == rows(df)
    assert rows(spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "c"))) == rows(df)
    assert publish.preview(df, 1).count() == 1


# -- preparation ----------------------------------------------------------------------


def test_carbon_preparation(spark):
    cell = pack(8, 40000, 20000)
    raw = spark.createDataFrame([(0, cell, 1.5), (0, cell, None)], "h0 long, h_zoom long, Z double")
    clean = prepare.clean_values(raw)
    assert clean.columns == ["h0", "carbon", "h8"] and clean.count() == 1
    ready = prepare.with_parents(clean, 8, range(3, 8))
    row = ready.first()
    assert row["h3"] == pack(3, 40000 // 243, 20000 // 243) and row["h7"] == pack(7, 13333, 6666)
    assert rows(prepare.quality_report(raw, "Z")) == [("missing", 1), ("present", 1), ("rows", 2)]


def test_admin_and_tract_layers(spark):
    divisions = spark.createDataFrame(
        [(1, "region", True, ("A",)), (2, "county", True, ("B",))],
        "id int, subtype string, is_land boolean, names struct<primary:string>",
    )
    assert rows(prepare.admin_layer(divisions, "region"), "id", "primary") == [(1, "A")]
    tract = spark.createDataFrame([("F1", "shape")], "FIPS string, Shape string")
    assert prepare.tract_layer(tract).columns == ["FIPS", "geometry", "id"]


def test_base_grid(spark, facts):
    table = base_grid(prepare.with_parents(facts, 3, [0]))
    assert table.columns == ["h0", "geom"]
    assert table.count() == facts.select(grid.parent("h3", 3, 0)).distinct().count()


# -- styling --------------------------------------------------------------------------


def test_ramp_hits_its_stops(spark):
    last = len(style.VIRIDIS) - 1
    values = [(i / last,) for i in range(last + 1)] + [(-1.0,), (2.0,), (None,)]
    df = spark.createDataFrame(values, "v double")
    got = [r[0] for r in df.select(style.ramp_colour(F.col("v"))).collect()]
    stops = [s.lower() for s in style.VIRIDIS]
    assert got == [*stops, stops[0], stops[-1], None]
    half = spark.range(1).select(style.ramp_colour(F.lit(0.5), ("#000000", "#ffffff"))).first()[0]
    assert half == "#808080"


def test_recode_and_label(spark):
    df = spark.createDataFrame([("1",), ("9",), (None,)], "g string")
    assert [r[0] for r in df.select(style.gap_colour(F.col("g"))).collect()] == ["#26633d", "#D3D3D3", "#D3D3D3"]
    text = df.limit(1).select(style.label({"A": F.col("g"), "B": F.lit(None)})).first()[0]
    assert text == "A: 1<br>B: "



def test_text_partitions_meet_numbered_areas(spark):
    facts = spark.createDataFrame([(1, "8a1FB"), (2, "8A1FB"), (3, "8a1fb"), (4, "11")], "v int, h0 string")
    facts = facts.withColumn("h0", F.when(F.col("v") == 1, F.upper("h0")).otherwise(F.lower("h0")))
    aoi = spark.createDataFrame([(0x8A1FB,)], "h0 long")
    assert sorted(r["v"] for r in tables.open_region(facts, aoi).collect()) == [1, 2, 3]
    numbers = facts.withColumn("h0", F.conv("h0", 16, 10).cast("long"))
    text = spark.createDataFrame([("8A1fb",)], "h0 string")
    assert tables.open_region(numbers, text).count() == 3


def test_dictionaries_of_other_content_share_no_entry(spark):
    columns = "cell long, lng double, lat double"
    first, second = (
        DictionaryGrid(spark.createDataFrame([(1, 0.0, lat)], columns)) for lat in (1.0, 2.0)
    )
    assert cache.grid_key(first) != cache.grid_key(second)
    assert cache.grid_key(first) == cache.grid_key(DictionaryGrid(first.dictionary))


def test_unreadable_and_bare_documents_keep_a_row(spark):
    texts = [
        '{"type":"Point","coordinates":[3,4]}',
        '{"type":"LineString","coordinates":[[0,0],[1,1]]}',
        '{"type":"Polyg',
        '{"type":"FeatureCollection","features":[]}',
        '{"type":"Feature","properties":{},"geometry":null}',
        None,
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "n int, json string")
    found = {r["n"]: r for r in features.parse_geojson(documents, "json").collect()}
    assert sorted(found) == [0, 1, 2, 4, 5]
    assert tuple(found[0]["point"]) == (3.0, 4.0) and found[0]["error"] is None
    assert found[1]["error"] == "no area or point: LineString"
    assert found[2]["error"] == found[5]["error"] == "not GeoJSON"
    assert found[4]["error"] is None and found[4]["geometry"] is None
