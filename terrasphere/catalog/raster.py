"""Raster pixels: windows, tiles, bands, sampling and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.functions.vec import quantize
from terrasphere.operators import raster as R
from terrasphere.sources import pixels as P

C = F.col


@query("src_pixels", ora("pixels", """
SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, CAST(max(px)+1 AS INTEGER) AS width, sum(value) AS total FROM pixels GROUP BY image_id"""))
def _(fx):
    return fx.pixels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("pixels"), (F.max("px") + 1).alias("width"), F.sum("value").alias("total"))


@query("src_read_rectangle", ora("pixels images", """
SELECT image_id AS rect_id, image_id, px, py, value FROM pixels
WHERE px>=image_id%5+2 AND px<image_id%5+12 AND py>=3 AND py<30"""))
def _(fx):
    """One window per image, reaching beyond its border."""
    rects = fx.images.select(
        C("image_id").alias("rect_id"), "image_id", (C("image_id") % 5 + 2).alias("x0"), F.lit(3).alias("y0"),
        F.lit(10).alias("w"), F.lit(27).alias("h"))
    return P.read_rectangles(fx.pixels, rects, size=8)


@query("src_tiles_from_pixels", ora("pixels", """
SELECT image_id, CAST(px//8 AS INTEGER) AS tile_x, CAST(py//8 AS INTEGER) AS tile_y, CAST(count(*) AS INTEGER) AS filled,
 sum(value*((py%8)*8+px%8)) AS checksum FROM pixels GROUP BY 1,2,3"""))
def _(fx):
    t = P.tiles_from_pixels(fx.pixels, 8)
    filled = F.size(F.filter("values", lambda v: v.isNotNull()))
    checksum = F.aggregate(
        F.transform("values", lambda v, i: F.coalesce(v, F.lit(0.0)) * i), F.lit(0.0), lambda a, v: a + v)
    return t.select("image_id", "tile_x", "tile_y", filled.alias("filled"), checksum.alias("checksum"))


@query("src_pixels_from_tiles", ora("pixels", "SELECT image_id, px, py, value FROM pixels"))
def _(fx):
    return P.pixels_from_tiles(P.tiles_from_pixels(fx.pixels, 8), 8)


@query("src_band_replicate", ora("rgb_pixels", """
SELECT image_id, px, py, b1, CASE WHEN b2 IS NULL THEN b1 ELSE b2 END AS b2,
 CASE WHEN b3 IS NOT NULL THEN b3 WHEN b2 IS NOT NULL THEN b2 ELSE b1 END AS b3 FROM rgb_pixels"""))
def _(fx):
    return P.band_replicate(fx.rgb_pixels)


@query("src_nodata_to_null", ora("pixels images", """
SELECT p.image_id, p.px, p.py, CASE WHEN p.value=(CASE WHEN p.image_id%4=0 THEN 2 ELSE i.nodata END) THEN NULL ELSE p.value END AS value
FROM pixels p JOIN images i ON i.image_id=p.image_id"""))
def _(fx):
    """Every fourth image overrides its nodata value with 2."""
    override = F.when(C("image_id") % 4 == 0, F.lit(2.0))
    df = fx.pixels.join(fx.images.select("image_id", "nodata"), "image_id")
    return df.select("image_id", "px", "py", P.nodata_to_null(C("value"), C("nodata"), override).alias("value"))


INGESTED = """ing AS (SELECT p.image_id, p.px, p.py, CASE WHEN p.value<>i.nodata THEN i.px_offset+i.px_scale*p.value END AS value
 FROM pixels p JOIN images i ON i.image_id=p.image_id)"""


@query("src_value_transform", ora("pixels images", "SELECT image_id, px, py, value FROM ing", INGESTED))
def _(fx):
    return P.ingest(fx.pixels, fx.images)


@query("qa_dataset_summary", ora("pixels images", """
SELECT image_id, CAST(max(px)+1 AS INTEGER) AS width, CAST(max(py)+1 AS INTEGER) AS height, CAST(nullif(count(px),0) AS BIGINT) AS stored,
 min(value) AS min_value, max(value) AS max_value, any_value(gt0) AS gt0, any_value(gt3) AS gt3, any_value(nodata) AS nodata
FROM images LEFT JOIN pixels USING (image_id) GROUP BY image_id"""))
def _(fx):
    return P.dataset_summary(fx.pixels, fx.images).select(
        "image_id", "width", "height", "stored", "min_value", "max_value", "gt0", "gt3", "nodata")


def _snap(raw: str, size: str) -> str:
    return (f"CASE WHEN point_sampled THEN {raw} WHEN {raw}-0.5<0 AND {raw}-0.5>=-0.5 THEN 0.0 "
            f"WHEN {raw}-0.5>{size}-1 AND {raw}-0.5<={size}-0.5 THEN {size}-1.0 ELSE {raw}-0.5 END")


SAMPLES = f"""smp AS (SELECT * FROM (SELECT point_id, image_id, ord, {_snap('((lon_deg-gt0)*gt5/(gt1*gt5))', 'size_x')} AS sx,
  {_snap('((lat_deg-gt3)*gt1/(gt1*gt5))', 'size_y')} AS sy, size_x, size_y
 FROM geo_points JOIN images ON lon_deg BETWEEN gt0-1 AND gt0+13 AND lat_deg BETWEEN gt3-13 AND gt3+1)
 WHERE sx>=0 AND sx<=size_x-1 AND sy>=0 AND sy<=size_y-1)"""


@query("ras_sample_points", ora("geo_points images", f"SELECT point_id, image_id, {S.q('sx')} AS sx, {S.q('sy')} AS sy FROM smp", SAMPLES))
def _(fx):
    return R.sample_points(fx.geo_points, fx.images, ["point_id"]).select("point_id", "image_id", quantize(C("sx")).alias("sx"), quantize(C("sy")).alias("sy"))


@query("ras_chunk_reads", ora("geo_points images", """
SELECT image_id, CAST(floor(sx/8) AS INTEGER) AS bx, CAST(floor(sy/8) AS INTEGER) AS by_, CAST(count(*) AS BIGINT) AS samples FROM smp GROUP BY 1,2,3""", SAMPLES))
def _(fx):
    """Reads are bounded by the pixel block a sample falls into."""
    return R.chunk_reads(fx.geo_points, fx.images, 8).select("image_id", "bx", C("by").alias("by_"), "samples")


@query("ras_nearest", ora("geo_points images pixels", """
SELECT s.point_id, s.image_id, i.value FROM smp s LEFT JOIN ing i ON i.image_id=s.image_id AND i.px=floor(s.sx+0.5) AND i.py=floor(s.sy+0.5)""", SAMPLES, INGESTED))
def _(fx):
    return R.nearest_at(fx.geo_points, fx.images, P.ingest(fx.pixels, fx.images), ["point_id"]).select("point_id", "image_id", "value")


# gather form of the bilinear sample: four left joins
BILINEAR = """tap AS (SELECT *, CASE WHEN floor(sx)=size_x-1 THEN floor(sx)-1 ELSE floor(sx) END AS x0, CASE WHEN floor(sy)=size_y-1 THEN floor(sy)-1 ELSE floor(sy) END AS y0 FROM smp),
bil AS (SELECT t.point_id, t.image_id, t.ord, sx-x0 AS dx, sy-y0 AS dy, a.value AS v00, b.value AS v10, c.value AS v01, d.value AS v11,
  CASE WHEN v00 IS NULL THEN 0 ELSE (1-dx)*(1-dy) END + CASE WHEN v10 IS NULL THEN 0 ELSE dx*(1-dy) END
  + CASE WHEN v01 IS NULL THEN 0 ELSE (1-dx)*dy END + CASE WHEN v11 IS NULL THEN 0 ELSE dx*dy END AS wv,
  coalesce(v00,0)*(1-dx)*(1-dy)+coalesce(v10,0)*dx*(1-dy)+coalesce(v01,0)*(1-dx)*dy+coalesce(v11,0)*dx*dy AS tot
 FROM tap t LEFT JOIN ing a ON a.image_id=t.image_id AND a.px=x0 AND a.py=y0 LEFT JOIN ing b ON b.image_id=t.image_id AND b.px=x0+1 AND b.py=y0
 LEFT JOIN ing c ON c.image_id=t.image_id AND c.px=x0 AND c.py=y0+1 LEFT JOIN ing d ON d.image_id=t.image_id AND d.px=x0+1 AND d.py=y0+1)"""


@query("ras_bilinear", ora("geo_points images pixels", f"""
SELECT point_id, image_id, {S.q('CASE WHEN wv>0 THEN tot/wv END')} AS value, {S.q('tot+(1-wv)*7.5')} AS value_over FROM bil""", SAMPLES, INGESTED, BILINEAR))
def _(fx):
    """Over nothing (renormalised) and over an earlier value of 7.5 (blended)."""
    parts = R.bilinear_at(fx.geo_points, fx.images, P.ingest(fx.pixels, fx.images), ["point_id"], ["value"])
    total, w = C("value_sum"), C("w_valid")
    return parts.select(
        "point_id", "image_id", quantize(R.blend(total, w, F.lit(None).cast("double"))).alias("value"),
        quantize(R.blend(total, w, F.lit(7.5))).alias("value_over"))


_RGB = BILINEAR.replace("ing ", "rgb ").replace("a.value AS v00, b.value AS v10, c.value AS v01, d.value AS v11", "a.b1 AS v00, b.b1 AS v10, c.b1 AS v01, d.b1 AS v11, a.b3 AS g00, b.b3 AS g10, c.b3 AS g01, d.b3 AS g11, a.b2 AS h00, b.b2 AS h10, c.b2 AS h01, d.b2 AS h11").replace(
    "AS tot\n", "AS tot, coalesce(g00,0)*(1-dx)*(1-dy)+coalesce(g10,0)*dx*(1-dy)+coalesce(g01,0)*(1-dx)*dy+coalesce(g11,0)*dx*dy AS tot3, coalesce(h00,0)*(1-dx)*(1-dy)+coalesce(h10,0)*dx*(1-dy)+coalesce(h01,0)*(1-dx)*dy+coalesce(h11,0)*dx*dy AS tot2\n")


@query("ras_bilinear_rgb", ora("geo_points images rgb_pixels", """
SELECT point_id, image_id, CAST(floor(least(greatest(tot/wv+1e-9,0),255)+0.5) AS INTEGER) AS r, CAST(floor(least(greatest(tot2/wv+1e-9,0),255)+0.5) AS INTEGER) AS g, CAST(floor(least(greatest(tot3/wv+1e-9,0),255)+0.5) AS INTEGER) AS b
FROM bil WHERE wv>0""", SAMPLES, "rgb AS (SELECT image_id, px, py, b1, coalesce(b2,b1) AS b2, coalesce(b3,b2,b1) AS b3 FROM rgb_pixels)", _RGB))
def _(fx):
    # 1e-9 on both sides keeps exact halves from depending on the order of summation
    px = P.band_replicate(fx.rgb_pixels)
    parts = R.bilinear_at(fx.geo_points, fx.images, px, ["point_id"], ["b1", "b2", "b3"]).where(C("w_valid") > 0)
    none = F.lit(None).cast("double")
    return parts.select(
        "point_id", "image_id", *[R.to_byte(R.blend(C(b + "_sum"), C("w_valid"), none) + 1e-9).alias(o) for b, o in (("b1", "r"), ("b2", "g"), ("b3", "b"))])


@query("ras_mosaic_nearest", ora("geo_points images pixels", """
SELECT point_id, arg_max(i.value, s.ord) AS value FROM smp s JOIN ing i ON i.image_id=s.image_id AND i.px=floor(s.sx+0.5) AND i.py=floor(s.sy+0.5)
WHERE i.value IS NOT NULL GROUP BY point_id""", SAMPLES, INGESTED))
def _(fx):
    return R.mosaic_nearest(fx.geo_points, fx.images, P.ingest(fx.pixels, fx.images), ["point_id"])


@query("ras_mosaic_bilinear", ora("geo_points images pixels", f"""
SELECT point_id, {S.q('v')} AS value FROM fold JOIN (SELECT point_id, max(k) AS k FROM seq GROUP BY point_id) USING (point_id, k)""",
    SAMPLES, INGESTED, BILINEAR, "seq AS (SELECT point_id, tot, wv, row_number() OVER (PARTITION BY point_id ORDER BY ord) AS k FROM bil)",
    """fold AS (SELECT point_id, k, CASE WHEN wv>0 THEN tot/wv END AS v FROM seq WHERE k=1
 UNION ALL SELECT s.point_id, s.k, CASE WHEN f.v IS NOT NULL THEN s.tot+(1-s.wv)*f.v WHEN s.wv>0 THEN s.tot/s.wv END FROM fold f JOIN seq s ON s.point_id=f.point_id AND s.k=f.k+1)""",
    recursive=True))
def _(fx):
    """Images in order; a hole blends with what the earlier images left."""
    parts = R.unhidden_parts(fx.geo_points, fx.images, P.ingest(fx.pixels, fx.images), "point_id")
    return R.mosaic_blend(parts, ["point_id"], chunk=8).select("point_id", quantize(C("value")).alias("value"))


@query("ras_pixel_ops", ora("rgb_pixels", """
SELECT image_id, px, py, CASE WHEN b2 IS NULL THEN b1 ELSE (b1+b2)*0.5 END AS avg2,
 (coalesce(b1,0)+coalesce(b2,0)+coalesce(b3,0))/((b1 IS NOT NULL)::INT+(b2 IS NOT NULL)::INT+(b3 IS NOT NULL)::INT+0.0) AS avg4,
 CASE WHEN b2 IS NULL OR b1<b2 THEN b1 ELSE b2 END AS min2, CASE WHEN b2 IS NULL OR b1>b2 THEN b1 ELSE b2 END AS max2,
 CAST(floor((CASE WHEN b2 IS NULL THEN b1 ELSE (b1+b2)*0.5 END)+0.5) AS INTEGER) AS avg2_byte FROM rgb_pixels"""))
def _(fx):
    b1, b2, b3 = C("b1"), C("b2"), C("b3")
    return fx.rgb_pixels.select(
        "image_id", "px", "py", R.avg_valid(b1, b2).alias("avg2"), R.avg_valid(b1, b2, b3, F.lit(None)).alias("avg4"),
        R.min_valid(b1, b2).alias("min2"), R.max_valid(b1, b2).alias("max2"), R.avg_byte(b1, b2).alias("avg2_byte"))
