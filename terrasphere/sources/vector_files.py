"""Palettes, symbols and map lines as text or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS
from terrasphere.functions.sphere import cart_to_geodetic, geodetic_to_cart
from terrasphere.functions.vec import V3, put
from terrasphere.operators.ordered import CHUNK_ROWS, chunk_of, forward_fill
from terrasphere.sources.text import is_comment, tokens

RGBA = ("r", "g", "b", "a")


def parse_palettes(lines: DataFrame, min_points: int = 3) -> DataFrame:
    """Points (palette_id, line_no, value, r, g, b, a) of text lines (palette_id, line_no, value).

    Comments and malformed lines are skipped; a palette with too few points is dropped.
    """
    t = lines.where(~is_comment(F.col("value"))).withColumn("_t", tokens(F.col("value")))
    number = lambda i: F.expr(f"try_cast(get(_t, {i}) AS double)")
    pts = t.select("palette_id", "line_no", number(0).alias("value"), *[number(i + 1).alias(c) for i, c in enumerate(RGBA)])
    pts = pts.dropna(subset=["value", *RGBA])
    enough = pts.groupBy("palette_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return pts.join(enough, "palette_id", "left_semi")


def format_palettes(points: DataFrame) -> DataFrame:
    """Text line per palette point."""
    return points.withColumn("text", F.concat_ws(" ", "value", *RGBA))


def parse_symbols(lines: DataFrame) -> DataFrame:
    """Symbols of text lines (line_no, value); the last line of an id wins.

    `group NAME` and `defaultSymbol` set the context of the symbol lines after them; the
    name is group-token, and the y origin of the atlas rectangle is flipped.
    """
    body = lines.where(~is_comment(F.col("value")) & (F.trim("value") != "")).withColumn("_t", tokens(F.col("value")))
    head = F.col("_t")[0]
    df = forward_fill(body.withColumns({
        "_group": F.when(head == "group", F.coalesce(F.get("_t", F.lit(1)), F.lit(""))),
        "_default": F.when(head == "defaultSymbol", True).when(head == "group", False),
    }), ["_group", "_default"], ord_col="line_no")
    num = lambda i: F.expr(f"try_cast(get(_t, {i}) AS double)")
    sym = df.where(F.col("_default").isNotNull() & ~head.isin("group", "defaultSymbol")).select(
        "line_no", F.expr("try_cast(get(_t, 1) AS bigint)").alias("symbol_id"),
        F.concat(F.coalesce("_group", F.lit("")), F.lit("-"), head).alias("symbol_name"), F.col("_default").alias("is_default"),
        *[num(i + 2).alias(c) for i, c in enumerate(RGBA)], num(6).alias("origin_x"), (1.0 - num(7)).alias("origin_y"),
        num(8).alias("size_x"), num(9).alias("size_y"))
    sym = sym.where(F.col("symbol_id").isNotNull() & F.col("size_y").isNotNull())
    cols = [c for c in sym.columns if c not in ("line_no", "symbol_id")]
    return sym.groupBy("symbol_id").agg(F.max_by(F.struct(*cols), "line_no").alias("_s")).select("symbol_id", "_s.*")


COORDS = "array<array<double>>"


def write_lines(points: DataFrame, radius: float = EARTH_RADIUS, part_rows: int = CHUNK_ROWS) -> DataFrame:
    """GeoJSON features of lines (line_id, ord, x, y, z, symbol_id).

    A line longer than part_rows points becomes several features with the same id, so no
    line is gathered whole.
    """
    lon, lat, elev = cart_to_geodetic(V3.of(""), radius)
    g = points.withColumn("part", chunk_of(rows=part_rows)).withColumn("_c", F.array(lon, lat, elev))
    feat = g.groupBy("line_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("ord", "_c"))).alias("_p"), F.max("symbol_id").alias("symbol"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("_p", lambda v: v["_c"]).alias("coordinates"))
    props = F.struct("line_id", "part", F.col("symbol").alias("Symbol"))
    return feat.select("line_id", "part", F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("feature"))


def read_features(features: DataFrame, symbols: DataFrame, default_symbol: int = 0, radius: float = EARTH_RADIUS) -> DataFrame:
    """Control points of 3-D line string features (column feature, JSON); other geometry is skipped.

    An unknown symbol becomes the default one.
    """
    schema = (
        f"type string, geometry struct<type:string,coordinates:{COORDS}>, "
        "properties struct<line_id:bigint,part:bigint,Symbol:int>")
    f = features.select(F.from_json("feature", schema).alias("f"))
    ok = (F.col("f.geometry.type") == "LineString") & F.forall("f.geometry.coordinates", lambda c: F.size(c) == 3)
    f = f.where(ok)
    known = symbols.select("symbol_id").distinct()
    pts = f.select(
        F.col("f.properties.line_id").alias("line_id"), F.col("f.properties.part").alias("part"),
        F.col("f.properties.Symbol").alias("symbol_id"), F.posexplode("f.geometry.coordinates").alias("pos", "c"))
    pts = pts.join(known.withColumn("_known", F.lit(True)), "symbol_id", "left")
    pts = pts.withColumns({
        "symbol_id": F.when(F.col("_known"), F.col("symbol_id")).otherwise(F.lit(default_symbol)),
        "lon_deg": F.col("c")[0], "lat_deg": F.col("c")[1], "elev": F.col("c")[2]}).drop("_known", "c")
    return put(pts, **{"": geodetic_to_cart(F.col("lon_deg"), F.col("lat_deg"), F.col("elev"), radius)})


def delete_lines(points: DataFrame, bridge: DataFrame, line_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop lines and their coverage."""
    ids = line_ids.select("line_id").distinct()
    return points.join(ids, "line_id", "left_anti"), bridge.join(ids, "line_id", "left_anti")


def delete_all(points: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.where(F.lit(False)), bridge.where(F.lit(False))
