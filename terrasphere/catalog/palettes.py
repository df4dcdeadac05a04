"""Palettes, colour mapping and layer blending over pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.functions.vec import quantize
from terrasphere.operators import palette as PL
from terrasphere.operators import pyramid as Y
from terrasphere.sources import vector_files as VF

C = F.col
RGBA = PL.RGBA


def rgba_q(scale=1e6):
    return [quantize(C(c), scale).alias(c) for c in RGBA]


# values reach beyond both ends of the palette (0..50)
VALUES = "vals AS (SELECT image_id, px, py, CASE WHEN value=1 THEN NULL ELSE value*1.3-6 END AS value FROM pixels)"


def values(fx):
    return fx.pixels.withColumn("value", F.when(C("value") != 1, C("value") * 1.3 - 6))


IV = """iv AS (SELECT * FROM (SELECT value AS lo, lead(value) OVER w AS hi, r, g, b, a, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2, lead(a) OVER w AS a2,
 row_number() OVER w AS i, count(*) OVER () AS n FROM palette WINDOW w AS (ORDER BY value)) WHERE hi IS NOT NULL)"""


def lerp(v: str, c: str) -> str:
    return f"({c}*(hi-{v})+{c}2*({v}-lo))/(hi-lo)"


def on(v: str) -> str:
    return f"(i=1 OR {v}>lo) AND (i=n-1 OR {v}<=hi)"


@query("pal_interpolate", ora("pixels palette", "SELECT v.image_id, v.px, v.py, " + ", ".join(f"{S.q(lerp('v.value', c))} AS {c}" for c in RGBA)
                              + f" FROM vals v LEFT JOIN iv ON {on('v.value')}", VALUES, IV))
def _(fx):
    return PL.interpolate(values(fx), fx.palette).select("image_id", "px", "py", *rgba_q())


TABLE = f"""tab AS (SELECT idx, {', '.join(lerp('x', c) + ' AS ' + c for c in RGBA)} FROM (SELECT idx, lo_+(hi_-lo_)/K1*idx AS x FROM (SELECT unnest(range(K0)) AS idx), (SELECT min(value) AS lo_, max(value) AS hi_ FROM palette)) JOIN iv ON {on('x')})"""


def table(k: int) -> str:
    return TABLE.replace("K1", f"{k - 1}.0").replace("K0", str(k))


@query("pal_discretize", ora("pixels palette", "SELECT CAST(idx AS INTEGER) AS idx, " + ", ".join(f"{S.q(c)} AS {c}" for c in RGBA)
                             + ", CAST(coalesce(n,0) AS BIGINT) AS pixels FROM tab LEFT JOIN (SELECT CAST(floor(value*255/50+0.5) AS INTEGER) AS idx, count(*) AS n FROM pixels GROUP BY 1) USING (idx)", IV, table(256)))
def _(fx):
    """A 256-colour table and how many pixels fall on each colour."""
    t = PL.discretize(fx.palette, 256)
    n = fx.pixels.groupBy(PL.table_index(C("value"), F.lit(0.0), F.lit(50.0), 256).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "idx", "left").select("idx", *rgba_q(), F.coalesce("n", F.lit(0)).alias("pixels"))


@query("pal_map_layer", ora("pixels palette", "SELECT v.image_id, v.px, v.py, " + ", ".join(f"{S.q(f'coalesce({c},0.0)')} AS {c}" for c in RGBA)
                            + " FROM vals v LEFT JOIN tab ON v.value IS NOT NULL AND idx=CAST(floor(least(greatest(value/50,0),1)*1023+0.5) AS INTEGER)", VALUES, IV, table(1024)))
def _(fx):
    return PL.map_layer(values(fx), fx.palette).select("image_id", "px", "py", *rgba_q())


# one palette per residue of the image, cut from the fixed one and scaled
PALS = """pals AS (SELECT CAST(k AS BIGINT) AS pid, value*(1+k) AS value, r, g, b, a FROM palette, (VALUES (0),(1),(2)) AS t(k) WHERE NOT (k=1 AND value=25))"""
IVK = """iv AS (SELECT * FROM (SELECT pid, value AS lo, lead(value) OVER w AS hi, r, g, b, a, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2, lead(a) OVER w AS a2,
 row_number() OVER w AS i, count(*) OVER (PARTITION BY pid) AS n FROM pals WINDOW w AS (PARTITION BY pid ORDER BY value)) WHERE hi IS NOT NULL)"""
TABK = f"""tab AS (SELECT pid, idx, {', '.join(lerp('x', c) + ' AS ' + c for c in RGBA)} FROM (SELECT pid, idx, lo_+(hi_-lo_)/255.0*idx AS x FROM (SELECT unnest(range(256)) AS idx), (SELECT pid, min(value) AS lo_, max(value) AS hi_ FROM pals GROUP BY pid)) JOIN iv USING (pid) WHERE {on('x')})"""


@query("pal_map_layers", ora("pixels palette", "SELECT v.image_id, v.px, v.py, " + ", ".join(f"{S.q(f'coalesce({c},0.0)')} AS {c}" for c in RGBA)
                             + " FROM vals v LEFT JOIN tab ON pid=image_id%4 AND v.value IS NOT NULL AND idx=CAST(floor(least(greatest(value/(50*(1+pid)),0),1)*255+0.5) AS INTEGER)", VALUES, PALS, IVK, TABK))
def _(fx):
    """Pixels of a table whose images have palettes of their own; every fourth image has none."""
    k = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("pid")
    pals = fx.palette.select(k, "*").where(~((C("pid") == 1) & (C("value") == 25))).withColumn("value", C("value") * (1 + C("pid")))
    df = values(fx).withColumn("pid", C("image_id") % 4)
    return PL.map_layer(df, pals, k=256, key="pid").select("image_id", "px", "py", *rgba_q())


@query("pal_value_range", ora("pixels palette", """
SELECT image_id, {0} AS lo, {1} AS hi FROM (SELECT image_id, min(value) AS mn, max(value) AS mx FROM pixels GROUP BY image_id)""".format(
    S.q("mn+(mx-mn)*0.2"), S.q("mn+(mx-mn)*1.0"))))
def _(fx):
    """Every image's range applied to the palette: second and last point."""
    per = fx.pixels.groupBy("image_id").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    unit = PL.set_range(fx.palette, 0.0, 1.0).agg(F.sort_array(F.collect_list("value")).alias("v"))  # palette points
    r = per.crossJoin(F.broadcast(unit))  # one row
    at = lambda i: C("mn") + (C("mx") - C("mn")) * F.element_at("v", i)
    return r.select("image_id", quantize(at(2)).alias("lo"), quantize(at(-1)).alias("hi"))


@query("pal_range_edits", ora("pixels", """
SELECT image_id, value AS shift_min, 50+(value-0) AS shift_max, value AS set_min_lo, 50.0 AS set_min_hi, 0.0 AS set_max_lo, value AS set_max_hi
FROM (SELECT image_id, min(value) AS value FROM pixels GROUP BY image_id)"""))
def _(fx):
    per = fx.pixels.groupBy("image_id").agg(F.min("value").alias("value"))
    lo, hi, v = F.lit(0.0), F.lit(50.0), C("value")
    s, a, b = PL.shift_range(lo, hi, v), PL.set_min(lo, hi, v), PL.set_max(lo, hi, v)
    names = ("shift_min", "shift_max", "set_min_lo", "set_min_hi", "set_max_lo", "set_max_hi")
    return per.select("image_id", *[c.alias(n) for c, n in zip((*s, *a, *b), names)])


@query("pal_edit_points", ora("pixels palette", "SELECT value, CAST(count(*) AS BIGINT) AS points, " + ", ".join(f"{S.q(f'max({c})')} AS {c}" for c in RGBA) + """ FROM (
 SELECT CASE WHEN i=2 THEN 38.0 ELSE value END AS value, r, g, b, CASE WHEN i=2 THEN 0.25 ELSE a END AS a FROM (SELECT *, row_number() OVER (ORDER BY value)-1 AS i FROM palette) WHERE i<>1
 UNION ALL SELECT x AS value, """ + ", ".join(lerp("x", c) for c in RGBA) + f" FROM (SELECT DISTINCT value+0.5 AS x FROM pixels WHERE value<50) JOIN iv2 ON {on('x')}) GROUP BY value",
    """iv2 AS (SELECT * FROM (SELECT value AS lo, lead(value) OVER w AS hi, r, g, b, a, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2, lead(a) OVER w AS a2, row_number() OVER w AS i, count(*) OVER () AS n
 FROM (SELECT CASE WHEN i=2 THEN 38.0 ELSE value END AS value, r, g, b, CASE WHEN i=2 THEN 0.25 ELSE a END AS a FROM (SELECT *, row_number() OVER (ORDER BY value)-1 AS i FROM palette) WHERE i<>1) WINDOW w AS (ORDER BY value)) WHERE hi IS NOT NULL)"""))
def _(fx):
    """Point 2 moved to 38 and made translucent, point 1 deleted, a point inserted at every pixel value plus a half."""
    p = PL.delete_points(PL.move_point(fx.palette, 2, 38.0, 0.25), [0, 1, 4])
    out = PL.insert_points(p, fx.pixels.where(C("value") < 50).select((C("value") + 0.5).alias("value")).distinct())
    return out.groupBy("value").agg(F.count(F.lit(1)).alias("points"), *[quantize(F.max(c)).alias(c) for c in RGBA])


@query("pal_read_rgb", ora("rgb_pixels", f"""
SELECT image_id, px, py, {S.q('coalesce(b1/255.0,0)')} AS r, {S.q('coalesce(b2/255.0,0)')} AS g, {S.q('coalesce(b3/255.0,0)')} AS b, CASE WHEN b1 IS NULL THEN 0.0 ELSE 1.0 END AS a FROM rgb_pixels"""))
def _(fx):
    df = fx.rgb_pixels
    # a missing second or third band is zero here; only a missing first band means nodata
    r, g, b, a = PL.read_rgb(C("b1"), F.coalesce("b2", F.lit(0)), F.coalesce("b3", F.lit(0)))
    return df.select("image_id", "px", "py", r, g, b, a).withColumns({c: quantize(C(c)) for c in "rgb"})


# four layers per pixel: two colour layers, two float layers with opacity from the value
LAY = """lay AS (SELECT p.image_id, p.px, p.py, l.layer_id, l.layer_kind, (p.value+l.layer_id)/60 AS r, p.value/50 AS g, l.layer_id/5.0 AS b,
 CASE WHEN p.value=1 THEN 0.0 ELSE 1.0/(1+(p.px+l.layer_id)%3) END AS a FROM pixels p, layers l WHERE l.visible AND l.layer_kind<>'dem')"""


def layer_colors(fx):
    ly = fx.layers.where(C("visible") & (C("layer_kind") != "dem")).select("layer_id", "layer_kind")
    j = fx.pixels.crossJoin(F.broadcast(ly))  # the layer table, one row per layer
    a = F.when(C("value") == 1, F.lit(0.0)).otherwise(1.0 / (1 + (C("px") + C("layer_id")) % 3))
    return j.select("image_id", "px", "py", "layer_id", "layer_kind", ((C("value") + C("layer_id")) / 60).alias("r"),
                    (C("value") / 50).alias("g"), (C("layer_id") / 5.0).alias("b"), a.alias("a"))


@query("pal_mix", ora("pixels layers", "SELECT image_id, px, py, " + ", ".join(f"{S.q(c)} AS {c}" for c in "rgb") + """ FROM fold JOIN (SELECT image_id, px, py, max(k) AS k FROM seq GROUP BY ALL) USING (image_id, px, py, k)""",
    LAY, "seq AS (SELECT *, row_number() OVER (PARTITION BY image_id, px, py ORDER BY CASE WHEN layer_kind='color' THEN 0 ELSE 1 END, layer_id) AS k FROM lay)",
    """fold AS (SELECT image_id, px, py, k, 1+(r-1)*a AS r, 1+(g-1)*a AS g, 1+(b-1)*a AS b FROM seq WHERE k=1
 UNION ALL SELECT s.image_id, s.px, s.py, s.k, f.r+(s.r-f.r)*s.a, f.g+(s.g-f.g)*s.a, f.b+(s.b-f.b)*s.a FROM fold f JOIN seq s ON s.image_id=f.image_id AND s.px=f.px AND s.py=f.py AND s.k=f.k+1)""", recursive=True))
def _(fx):
    return PL.mix(layer_colors(fx), ["image_id", "px", "py"]).select("image_id", "px", "py", *[quantize(C(c)).alias(c) for c in "rgb"])


@query("pal_multiply", ora("pixels layers", "SELECT image_id, px, py, " + ", ".join(f"{S.q(f'product({c})')} AS {c}" for c in RGBA) + " FROM lay GROUP BY ALL", LAY))
def _(fx):
    return PL.multiply(layer_colors(fx), ["image_id", "px", "py"]).select("image_id", "px", "py", *rgba_q())


@query("pal_layer_toggles", ora("pixels layers", """
SELECT l.layer_id, l.layer_name, l.visible OR l.layer_id=4 AS visible, CASE WHEN l.layer_kind='color' THEN l.clamped ELSE true END AS clamped,
 CAST(row_number() OVER (ORDER BY CASE l.layer_kind WHEN 'color' THEN 0 WHEN 'dem' THEN 1 ELSE 2 END, l.layer_id)-1 AS INTEGER) AS index, CAST(n.n AS BIGINT) AS pixels
FROM layers l, (SELECT count(*) AS n FROM pixels) n"""))
def _(fx):
    ly = PL.layer_order(PL.set_clamping(PL.set_visibility(fx.layers, 4, True), None, True))
    n = fx.pixels.agg(F.count(F.lit(1)).alias("pixels"))
    return ly.crossJoin(F.broadcast(n)).select("layer_id", "layer_name", "visible", "clamped", "index", "pixels")


@query("pal_default_palettes", ora("lattice layers", """
SELECT layer_id, CASE WHEN layer_id%2=1 THEN 'grey' ELSE 'black' END AS palette_id, CASE WHEN layer_kind='dem' THEN mn ELSE 0.0 END AS range_min,
 CASE WHEN layer_kind='dem' THEN mx ELSE 1.0 END AS range_max, 2 AS points FROM layers, (SELECT min(value) AS mn, max(value) AS mx FROM lattice)"""))
def _(fx):
    assigned = fx.layers.where(C("layer_id") % 2 == 1).select("layer_id", F.lit("grey").alias("palette_id"))
    out = PL.with_palette(fx.layers, assigned, Y.global_range(fx.lattice))
    n = PL.default_palettes(fx.spark).groupBy("palette_id").agg(F.count(F.lit(1)).cast("int").alias("points"))
    return out.join(n, "palette_id").select("layer_id", "palette_id", "range_min", "range_max", "points")


# palette files made of customers: five points each, with comments, broken and short lines in between
PTEXT = """ptext AS (SELECT c_nationkey AS palette_id, c_custkey AS line_no, CASE c_custkey%6 WHEN 0 THEN '# customer' WHEN 1 THEN 'not a point'
 WHEN 2 THEN CAST(c_custkey AS VARCHAR)||' 0.5 0.25' ELSE CAST(c_custkey AS VARCHAR)||' 0.5  0.25 0.'||CAST(c_custkey%10 AS VARCHAR)||' 1.0' END AS value FROM customer)"""


def palette_text(fx):
    k = C("c_custkey").cast("string")
    v = F.when(C("c_custkey") % 6 == 0, "# customer").when(C("c_custkey") % 6 == 1, "not a point").when(
        C("c_custkey") % 6 == 2, F.concat(k, F.lit(" 0.5 0.25"))).otherwise(
        F.concat(k, F.lit(" 0.5  0.25 0."), (C("c_custkey") % 10).cast("string"), F.lit(" 1.0")))
    return fx.table("customer").select(C("c_nationkey").alias("palette_id"), C("c_custkey").alias("line_no"), v.alias("value"))


@query("pal_load", "WITH " + PTEXT + """
SELECT palette_id, line_no, CAST(line_no AS DOUBLE) AS value, 0.5::DOUBLE AS r, 0.25::DOUBLE AS g, CAST('0.'||CAST(line_no%10 AS VARCHAR) AS DOUBLE) AS b, 1.0::DOUBLE AS a FROM ptext p WHERE line_no%6>2
AND palette_id IN (SELECT palette_id FROM ptext q WHERE q.line_no%6>2 GROUP BY palette_id HAVING count(*)>=3)""")
def _(fx):
    return VF.parse_palettes(palette_text(fx))


@query("pal_save", "WITH " + PTEXT + """
SELECT palette_id, line_no, CAST(line_no AS VARCHAR)||'.0 0.5 0.25 0.'||CAST(line_no%10 AS VARCHAR)||' 1.0' AS text FROM ptext WHERE line_no%6>2
AND palette_id IN (SELECT palette_id FROM ptext q WHERE q.line_no%6>2 GROUP BY palette_id HAVING count(*)>=3)""")
def _(fx):
    return VF.format_palettes(VF.parse_palettes(palette_text(fx))).select("palette_id", "line_no", "text")
