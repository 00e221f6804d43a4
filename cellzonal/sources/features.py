"""Feature tables from GeoJSON, map views and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellzonal.functions import geometry as geo
from cellzonal.session import kept

_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<id:string,properties:map<string,string>,geometry:{_GEOMETRY}>"
_DOCUMENT = (
    f"struct<type:string,id:string,properties:map<string,string>,geometry:{_GEOMETRY},"
    f"coordinates:string,features:array<{_FEATURE}>>"
)
# Geometry types of GeoJSON.
_KINDS = (
    "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon",
    "GeometryCollection",
)


# Up to the first element of the member "features", where no other object stands before it.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_HEAD = rf'(?s)^\s*[\]{{]?(?:[^"{{}}]*+{_STRING})*?(?<="features")\s*+:\s*+\['


def read_geojson(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """GeoJSON files as features: documents of any size, or one feature per line."""
    if one_per_line:
        return parse_geojson(spark.read.text(path), "value")
    return parse_geojson(elements(spark, path), "value")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Texts of documents, collections cut into collections of one element each.

    Spark's line reader cuts files into pieces at ``}``, each block of a file by its own
    task. Whether a piece starts inside a string, and how deep, follows from the pieces
    before it: running sums in each block, then over the totals of blocks, without texts.
    Then the pieces of each element are put together, also across blocks. A document that
    is no collection, or unreadable, stays one text, and an empty file gives none. One
    element, and the sizes of one block's pieces, have to fit one task.
    """
    pieces = kept(_pieces(spark.read.option("lineSep", "}").text(path)))
    states = kept(_states(pieces))
    by_file = Window.partitionBy("_file")
    place = F.struct("_block", "_at")
    # Only the first features count, from their head to the bracket that closes them.
    heads = states.where("_head").groupBy("_file").agg(F.min(place).alias("_from"))
    shuts = states.where("_shut").select("_file", place.alias("_place")).join(heads, "_file")
    ends = shuts.where("_place > _from").groupBy("_file").agg(F.min("_place").alias("_to"))
    spans = heads.join(ends, "_file", "left")
    before = by_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = states.groupBy("_file", "_block").agg(F.sum("_ends").alias("_n"))
    offsets = offsets.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_from").isNull() | ((place >= F.col("_from")) & (F.col("_to").isNull() | (place < F.col("_to"))))
    numbered = (
        states.join(spans, "_file", "left")
        .where(inside)
        .join(offsets, ["_file", "_block"])
        .select(
            "_file", "_block", "_at",
            F.when(F.col("_from").isNotNull(), F.col("_offset") + F.col("_before")).alias("_element"),
            (place == F.col("_from")).alias("_first"),
        )
    )
    text = F.when(F.col("_first"), F.regexp_replace("value", _HEAD, "")).otherwise(F.col("value"))
    whole = pieces.join(numbered, ["_file", "_block", "_at"]).groupBy("_file", "_element").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_at", text.alias("_text")))).alias("_texts"),
        F.sum(F.octet_length("value") + 1).alias("_read"),
        F.first("_size").alias("_size"),
    )
    joined = F.array_join(F.col("_texts")["_text"], "}")
    # A file may end without a brace, and then it has a byte less than its pieces and braces.
    document = F.concat(joined, F.when(F.col("_read") == F.col("_size") + 1, "").otherwise("}"))
    element = F.regexp_replace(F.concat(joined, F.lit("}")), r"^\s*,", "")
    nothing = F.col("_element").isNotNull() & F.trim(joined, F.lit(" \t\r\n")).rlike(r"^(\]|$)")
    return whole.where(~nothing).select(
        F.when(F.col("_element").isNull(), document)
        .otherwise(F.concat(F.lit('{"type":"FeatureCollection","features":['), element, F.lit("]}")))
        .alias("value")
    )


def _pieces(raw: DataFrame) -> DataFrame:
    """Pieces in their order, with quotes, braces and brackets as if outside or inside a string."""
    text = F.col("value")
    bare = F.regexp_replace(text, r"(?s)\\.", "")

    def count(of: Column, mark: str) -> Column:
        return F.length(of) - F.length(F.replace(of, F.lit(mark), F.lit("")))

    strings = '"[^"]*("|$)'
    outside = [F.regexp_replace(bare, strings, ""), F.regexp_replace(F.concat(F.lit('"'), bare), strings, "")]
    found = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
        (count(bare, '"') % 2).alias("_odd"),
        *[o.alias(f"_o{i}") for i, o in enumerate(outside)],
        (text.contains('"features"') & F.coalesce(text.rlike(_HEAD), F.lit(False))).alias("_head"),
        text.rlike(r"^\s*\]").alias("_shut"),
    )
    depths = {
        f"{name}{i}": count(F.col(f"_o{i}"), up) - count(F.col(f"_o{i}"), down)
        for i in (0, 1)
        for name, up, down in (("_braces", "{", "}"), ("_brackets", "[", "]"))
    }
    return found.withColumns(depths).drop("_o0", "_o1")


def _states(pieces: DataFrame) -> DataFrame:
    """Where heads and closing brackets are and which pieces end an element, without texts."""
    block = ["_file", "_block"]
    here = Window.partitionBy(*block).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(of: Column, over) -> Column:
        return F.coalesce(F.sum(of).over(over), F.lit(0))

    def by_turn(turn: Column, name: str) -> Column:
        return F.when(turn == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    def closing(turn: Column) -> Column:
        # The brace that a piece was cut at counts unless it stands in a string.
        return F.when((turn + F.col("_odd")) % 2 == 0, 1).otherwise(0)

    turned = pieces.drop("value").withColumn("_turn", sum_before(F.col("_odd"), here) % 2)
    sums = [F.sum("_odd").alias("_odd")]
    for i in (0, 1):
        turn = (F.col("_turn") + i) % 2
        sums.append(F.sum(by_turn(turn, "_braces") - closing(turn)).alias(f"_d{i}"))
        sums.append(F.sum(by_turn(turn, "_brackets")).alias(f"_k{i}"))
    totals = turned.groupBy(*block).agg(*sums).withColumn("_start", sum_before(F.col("_odd"), earlier) % 2)
    starts = totals.select(
        *block, "_start",
        sum_before(by_turn(F.col("_start"), "_d"), earlier).alias("_d"),
        sum_before(by_turn(F.col("_start"), "_k"), earlier).alias("_k"),
    )
    turn = (F.col("_turn") + F.col("_start")) % 2
    deep = turned.join(starts, block).withColumn("_inside", turn)
    braces = by_turn(F.col("_inside"), "_braces") - closing(F.col("_inside"))
    brackets = by_turn(F.col("_inside"), "_brackets")
    deep = deep.withColumns({
        "_b": F.col("_d") + sum_before(braces, here),
        "_c": F.col("_k") + sum_before(brackets, here),
        "_db": braces,
        "_dc": brackets,
    })
    out = F.col("_inside") == 0
    shut = out & F.col("_shut") & (F.col("_b") == 1) & (F.col("_c") == 1)
    head = out & F.col("_head") & (F.col("_b") <= 1) & ((F.col("_c") == 0) | shut)
    ends = (closing(F.col("_inside")) == 1) & (F.col("_b") + F.col("_db") == 1) & (F.col("_c") + F.col("_dc") == 1)
    told = deep.select(*block, "_at", head.alias("_head"), shut.alias("_shut"), ends.cast("int").alias("_ends"))
    return told.withColumn("_before", sum_before(F.col("_ends"), here))


def parse_geojson(documents: DataFrame, json: str) -> DataFrame:
    """Feature rows from a column of GeoJSON text.

    A FeatureCollection gives one row per feature, a lone Feature or a bare geometry
    one row. Adds ``feature_id, properties, kind, geometry, point, error``: areas become
    parts and rings, a Point fills ``point``. What cannot be read, or is neither area nor
    point, keeps a row whose ``error`` says so.
    """
    rest = [c for c in documents.columns if c != json]
    parsed = documents.select(*rest, F.from_json(F.col(json), _DOCUMENT).alias("_d"))
    alone = F.struct("_d.id", "_d.properties", "_d.geometry")
    nothing = F.lit(None).cast(_FEATURE)
    bare = F.struct(
        nothing["id"].alias("id"),
        nothing["properties"].alias("properties"),
        F.struct("_d.type", "_d.coordinates").alias("geometry"),
    )
    features = (
        F.when(F.col("_d.type") == "Feature", F.array(alone))
        .when(F.col("_d.type").isin(*_KINDS), F.array(bare))
        .otherwise(F.coalesce("_d.features", F.array(nothing)))
    )
    rows = parsed.select(*rest, F.explode(features).alias("_f"))
    kind, text = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    shape, place = area_of(kind, text), point_of(kind, text)
    error = F.when(F.col("_f").isNull(), F.lit("not GeoJSON")).when(
        kind.isNotNull() & shape.isNull() & place.isNull(),
        F.concat(F.lit("no area or point: "), kind),
    )
    return rows.select(
        *rest,
        F.col("_f.id").alias("feature_id"),
        F.col("_f.properties").alias("properties"),
        kind.alias("kind"),
        shape.alias("geometry"),
        place.alias("point"),
        error.alias("error"),
    )


def area_of(kind: Column, coordinates: Column) -> Column:
    """Parts and rings of a Polygon or MultiPolygon, else null."""
    parts = F.when(
        kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))
    ).when(kind == "MultiPolygon", coordinates)
    return geo.from_coordinates(F.from_json(parts, "array<array<array<array<double>>>>"))


def point_of(kind: Column, coordinates: Column) -> Column:
    """Position of a Point, else null."""
    pair = F.from_json(F.when(kind == "Point", coordinates), "array<double>")
    return F.when(pair.isNotNull(), geo.point(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))


def views(boxes: DataFrame) -> DataFrame:
    """Map views ``xmin, ymin, xmax, ymax`` as features with a ``geometry``."""
    corner = [F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")]
    rest = [c for c in boxes.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    return boxes.select(*rest, geo.clamped_box(*corner).alias("geometry"))
