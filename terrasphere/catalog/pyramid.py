"""Pyramid kernels, statistics, builds and as-of-level joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.fixtures import LATTICE_LEVEL, LATTICE_N
from terrasphere.functions import keys
from terrasphere.functions.vec import quantize
from terrasphere.operators import pyramid as Y
from terrasphere.plans.build import build, build_images, read_ranges, update, update_images
from terrasphere.session import checkpoint_root
from terrasphere.sources.pyramid_store import BANDS, read_pyramid

C = F.col
N, L = LATTICE_N, LATTICE_LEVEL
D3 = "(VALUES (-1),(0),(1))"


def gather_down(src: str, level: int, weights: str = "(0.5-0.25*abs(dx))*(0.5-0.25*abs(dy))") -> str:
    """Parent vertices at `level` from src(patch, gx, gy, value) one level below, in gather form."""
    top = (N - 1) * 2**level
    return f"""(SELECT p.patch, p.px AS gx, p.qy AS gy, sum({weights}*c.value)/sum({weights}) AS value
 FROM (SELECT DISTINCT patch, (gx+ox)//2 AS px, (gy+oy)//2 AS qy FROM {src}, (VALUES (0),(1)) AS a(ox), (VALUES (0),(1)) AS b(oy)
  WHERE value IS NOT NULL AND (gx+ox)//2<={top} AND (gy+oy)//2<={top}) p, {D3} AS x(dx), {D3} AS y(dy), {src} c
 WHERE c.patch=p.patch AND c.gx=2*p.px+dx AND c.gy=2*p.qy+dy AND c.value IS NOT NULL GROUP BY ALL)"""


@query("pyr_downsample", ora("lattice", f"SELECT patch, {L - 1} AS level, gx, gy, {S.q('value')} AS value FROM {gather_down('lattice', L - 1)}"))
def _(fx):
    return Y.downsample(fx.lattice, N).select("patch", "level", "gx", "gy", quantize(C("value")).alias("value"))


def _custom(d: str) -> str:
    return f"(CASE abs({d}) WHEN 0 THEN 0.6 ELSE 0.2 END)"


@query("pyr_downsample_custom_kernel", ora("lattice", f"""
SELECT patch, {L - 1} AS level, gx, gy, {S.q('value')} AS value FROM {gather_down('lattice', L - 1, _custom('dx') + '*' + _custom('dy'))}"""))
def _(fx):
    """A user kernel given as weights."""
    return Y.downsample(fx.lattice, N, (0.2, 0.6, 0.2)).select("patch", "level", "gx", "gy", quantize(C("value")).alias("value"))


_W = ",".join(f"({d - 10},CAST({w!r} AS DOUBLE))" for d, w in enumerate(Y.LANCZOS5))


@query("pyr_downsample_lanczos", ora("lattice", f"""
SELECT p.patch, {L - 1} AS level, p.px AS gx, p.qy AS gy, {S.q('sum(w1*w2*c.value)')} AS numerator, {S.q('sum(w1*w2)')} AS weight
FROM (SELECT DISTINCT patch, (gx-d.d)//2 AS px, (gy-e.e)//2 AS qy FROM lattice, kern d(d,w1), kern e(e,w2)
  WHERE value IS NOT NULL AND gx-d.d>=0 AND gy-e.e>=0 AND (gx-d.d)%2=0 AND (gy-e.e)%2=0 AND (gx-d.d)//2<={(N - 1) * 2 ** (L - 1)} AND (gy-e.e)//2<={(N - 1) * 2 ** (L - 1)}) p,
 kern d(d,w1), kern e(e,w2), lattice c WHERE c.patch=p.patch AND c.gx=2*p.px+d AND c.gy=2*p.qy+e AND c.value IS NOT NULL
GROUP BY ALL HAVING sum(w1*w2)<>0""", f"kern(d,w) AS (VALUES {_W})"))
def _(fx):
    """Numerator and weight of every fed vertex; where next to no weight arrives, their quotient is undefined."""
    out = Y.downsample(fx.lattice, N, "lanczos5", with_weight=True)
    return out.select("patch", "level", "gx", "gy", quantize(C("numerator")).alias("numerator"), quantize(C("weight")).alias("weight"))


@query("pyr_downsample_point", ora("lattice", f"""
SELECT patch, {L - 1} AS level, gx//2 AS gx, gy//2 AS gy, value FROM lattice WHERE value IS NOT NULL AND gx%2=0 AND gy%2=0"""))
def _(fx):
    return Y.downsample(fx.lattice, N, "point")


def gather_up(src: str, level: int) -> str:
    top = (N - 1) * 2**level
    return f"""(SELECT c.patch, c.cx AS gx, c.cy AS gy, avg(p.value) AS value FROM (
  SELECT DISTINCT patch, 2*gx+dx AS cx, 2*gy+dy AS cy FROM {src}, {D3} AS x(dx), {D3} AS y(dy)
  WHERE value IS NOT NULL AND 2*gx+dx BETWEEN 0 AND {top} AND 2*gy+dy BETWEEN 0 AND {top}) c, (VALUES (0),(1)) AS a(ox), (VALUES (0),(1)) AS b(oy), {src} p
 WHERE ox<=cx%2 AND oy<=cy%2 AND p.patch=c.patch AND p.gx=cx//2+ox AND p.gy=cy//2+oy AND p.value IS NOT NULL GROUP BY ALL)"""


@query("pyr_upsample", ora("lattice", f"SELECT patch, {L + 1} AS level, gx, gy, {S.q('value')} AS value FROM {gather_up('lattice', L + 1)}"))
def _(fx):
    return Y.upsample(fx.lattice, N).select("patch", "level", "gx", "gy", quantize(C("value")).alias("value"))


def path_sql(level: int, tx: str, ty: str) -> str:
    return "CAST(" + "+".join(
        f"((({tx})//{2 ** (level - 1 - k)})%2+2*((({ty})//{2 ** (level - 1 - k)})%2))*{4**k}" for k in range(level)) + " AS BIGINT)" if level else "CAST(0 AS BIGINT)"


def tiles_cte(src: str, level: int, name: str = "vt") -> str:
    s, last = N - 1, 2**level - 1
    return f"""{name} AS (SELECT patch, gx, gy, value, gx//{s}-ox AS tx, gy//{s}-oy AS ty FROM {src}, (VALUES (0),(1)) AS a(ox), (VALUES (0),(1)) AS b(oy)
 WHERE (ox=0 OR (gx%{s}=0 AND gx>0)) AND (oy=0 OR (gy%{s}=0 AND gy>0)) AND gx//{s}-ox<={last} AND gy//{s}-oy<={last})"""


@query("pyr_refine_missing", ora("lattice", f"""
SELECT DISTINCT patch, {L + 1} AS level, gx, gy, {S.q('value')} AS value FROM (
 SELECT u.* FROM {gather_up('lattice', L + 1)} u, need n
 WHERE n.patch=u.patch AND u.gx BETWEEN n.tx*{N - 1} AND (n.tx+1)*{N - 1} AND u.gy BETWEEN n.ty*{N - 1} AND (n.ty+1)*{N - 1})""",
    tiles_cte("lattice", L), """need AS (SELECT DISTINCT patch, 2*tx+1 AS tx, 2*ty AS ty FROM vt WHERE value IS NOT NULL)"""))
def _(fx):
    """The lower right child of every tile is needed, none exists."""
    tiles = Y.tiles_of(fx.lattice.where(C("value").isNotNull()), N)
    level, path = keys.child(C("level"), C("path"), F.lit(1))
    needed = tiles.select("patch", level.alias("level"), path.alias("path"))
    out = Y.refine_missing(fx.lattice, needed, tiles, N)
    return out.select("patch", "level", "gx", "gy", quantize(C("value")).alias("value"))


@query("pyr_dirty_ancestors", ora("lattice", f"""
SELECT DISTINCT patch, CAST(l AS INTEGER) AS level, path%CAST(pow(4,l) AS BIGINT) AS path FROM (
 SELECT DISTINCT patch, {path_sql(L, 'tx', 'ty')} AS path FROM vt), (SELECT unnest(range({L})) AS l)""", tiles_cte("lattice", L)))
def _(fx):
    return Y.dirty_ancestors(Y.tiles_of(fx.lattice, N))


@query("pyr_tile_stats", ora("lattice", f"""
SELECT patch, CAST(l AS INTEGER) AS level, path%CAST(pow(4,l) AS BIGINT) AS path, min(value) AS min_value, max(value) AS max_value FROM (
 SELECT patch, value, {path_sql(L, 'tx', 'ty')} AS path FROM vt WHERE value IS NOT NULL), (SELECT unnest(range({L + 1})) AS l) GROUP BY ALL""", tiles_cte("lattice", L)))
def _(fx):
    return Y.tile_stats(fx.lattice, N)


@query("pyr_global_range", ora("lattice", "SELECT coalesce(min(value),0.0) AS min_value, coalesce(max(value),0.0) AS max_value FROM lattice"))
def _(fx):
    return Y.global_range(fx.lattice)


@query("ras_fill_defaults", ora("lattice", "SELECT patch, gx, gy, CASE WHEN value IS NULL THEN -5.0 ELSE value END AS value FROM lattice"))
def _(fx):
    return fx.lattice.select("patch", "gx", "gy", Y.fill_defaults(C("value"), -5.0).alias("value"))


_CHAIN = [f"lv{L} AS (SELECT patch, gx, gy, value FROM lattice WHERE value IS NOT NULL)"] + [
    f"lv{k} AS (SELECT patch, gx, gy, floor(value*1048576+0.5)/1048576 AS value FROM {gather_down(f'lv{k + 1}', k)})" for k in range(L - 1, -1, -1)]
_ALL = " UNION ALL ".join(f"SELECT patch, {k} AS level, gx, gy, {S.q('value', 1e4)} AS value FROM lv{k}" for k in range(L, -1, -1))


def scratch(fx, name):
    return f"{checkpoint_root(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query("pyr_build", ora("lattice", _ALL, *_CHAIN))
def _(fx):
    """All levels, each written to its partition before the next is derived from it."""
    out = build(fx.spark, fx.lattice, scratch(fx, "pyramid"), N)
    return out.select("patch", "level", "gx", "gy", quantize(C("value"), 1e4).alias("value"))


# a colour lattice: three bands of every vertex that has a value
_RGB = "rgb AS (SELECT patch, gx, gy, CAST(value*5 AS INTEGER) AS r, CAST((51-value)*5 AS INTEGER) AS g, CAST((gx*7+gy*3)%256 AS INTEGER) AS b FROM lattice WHERE value IS NOT NULL)"


def rgb_lattice(fx):
    v = C("value")
    return fx.lattice.where(v.isNotNull()).select("patch", "level", "gx", "gy", (v * 5).cast("int").alias("r"), ((51 - v) * 5).cast("int").alias("g"),
                                                  ((C("gx") * 7 + C("gy") * 3) % 256).cast("int").alias("b"))


def gather_rgb(src: str, level: int) -> str:
    w = "(0.5-0.25*abs(dx))*(0.5-0.25*abs(dy))"
    bands = ", ".join(f"CAST(floor(least(greatest(sum({w}*c.{b})/sum({w}),0),255)+0.5) AS INTEGER) AS {b}" for b in "rgb")
    return gather_down(src, level, w).replace(f"sum({w}*c.value)/sum({w}) AS value", bands).replace("value IS NOT NULL", "r IS NOT NULL")


@query("pyr_downsample_rgb", ora("lattice", f"SELECT patch, {L - 1} AS level, gx, gy, r, g, b FROM {gather_rgb('rgb', L - 1)}", _RGB))
def _(fx):
    return Y.downsample_rgb(rgb_lattice(fx), N)


_RGB_CHAIN = [f"cl{L} AS (SELECT patch, gx, gy, r, g, b FROM rgb)"] + [f"cl{k} AS (SELECT * FROM {gather_rgb(f'cl{k + 1}', k)})" for k in range(L - 1, -1, -1)]


@query("pyr_build_rgb", ora("lattice", " UNION ALL ".join(f"SELECT patch, {k} AS level, gx, gy, r, g, b FROM cl{k}" for k in range(L, -1, -1)), _RGB, *_RGB_CHAIN))
def _(fx):
    """A colour pyramid, three bands through the store."""
    return build(fx.spark, rgb_lattice(fx), scratch(fx, "pyramid"), N, "color", values=BANDS)


@query("pyr_build_images")
def _(fx):
    """All images and their pixels; every fifth image is twice as fine, every seventh covers its first half only."""
    finer = C("image_id") % 5 == 0
    images = fx.images.withColumns({"gt1": F.when(finer, C("gt1") / 2).otherwise(C("gt1")), "gt5": F.when(finer, C("gt5") / 2).otherwise(C("gt5"))})
    half = fx.images.where(C("image_id") % 7 == 0).select("image_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(((0.0, 0.0), (11.5, 0.0), (11.5, 23.0), (0.0, 23.0)))])))
    out, _ = build_images(fx.spark, images, fx.pixels, scratch(fx, "pyramid"), N, coverage=half)
    return out.select("patch", "level", "gx", "gy", quantize(C("value"), 1e3).alias("value"))


_UPD = [c.replace("FROM lattice", "FROM merged") for c in _CHAIN]


@query("pyr_update", ora("lattice", _ALL,
    """merged AS (SELECT patch, gx, gy, CASE WHEN patch%3=0 AND value IS NOT NULL AND gx%2=0 THEN value+100 ELSE value END AS value FROM lattice)""", *_UPD))
def _(fx):
    """Build, then apply changes to a third of the patches incrementally."""
    path = scratch(fx, "pyramid")
    build(fx.spark, fx.lattice, path, N)
    changes = fx.lattice.where((C("patch") % 3 == 0) & (C("gx") % 2 == 0)).withColumn("value", C("value") + 100)
    out = update(fx.spark, path, changes, N)
    return out.select("patch", "level", "gx", "gy", quantize(C("value"), 1e4).alias("value"))


_KEPT = " UNION ALL ".join(f"SELECT patch, {k} AS depth, {path_sql(k, 'tx', 'ty')} AS path, value FROM vt{k}" for k in range(L + 1))


@query("pyr_kept_ranges", ora("lattice", f"""
SELECT patch, CAST(l AS INTEGER) AS level, path%CAST(pow(4,l) AS BIGINT) AS path, {S.q('min(value)', 1e4)} AS min_value, {S.q('max(value)', 1e4)} AS max_value
FROM ({_KEPT}), (SELECT unnest(range({L + 1})) AS l) WHERE l<=depth GROUP BY ALL""",
    """merged AS (SELECT patch, gx, gy, CASE WHEN patch%3=0 AND value IS NOT NULL AND gx%2=0 THEN value+100 ELSE value END AS value FROM lattice)""", *_UPD,
    *[tiles_cte(f"lv{k}", k, f"vt{k}") for k in range(L + 1)]))
def _(fx):
    """Ranges kept beside the tiles, read after an update; nothing is computed from vertices here."""
    path = scratch(fx, "pyramid")
    build(fx.spark, fx.lattice, path, N, ranges=True)
    update(fx.spark, path, fx.lattice.where((C("patch") % 3 == 0) & (C("gx") % 2 == 0)).withColumn("value", C("value") + 100), N)
    return read_ranges(fx.spark, path).select("patch", "level", "path", *[quantize(C(c), 1e4).alias(c) for c in ("min_value", "max_value")])


@query("pyr_update_images")
def _(fx):
    """Three quarters of the images are built, the rest is added later; a test compares with a build of all."""
    path, late = scratch(fx, "pyramid"), C("image_id") % 4 == 0
    build_images(fx.spark, fx.images.where(~late), fx.pixels, path, N, updatable=True)
    out, _ = update_images(fx.spark, path, fx.images.where(late), fx.images, fx.pixels, N)
    return out.select("patch", "level", "gx", "gy", quantize(C("value"), 1e3).alias("value"))


@query("src_write_read_pyramid", ora("lattice", "SELECT patch, level, gx, gy, value FROM lattice WHERE value IS NOT NULL"))
def _(fx):
    from terrasphere.sources.pyramid_store import write_pyramid

    path = scratch(fx, "store")
    write_pyramid(fx.lattice.where(C("value").isNotNull()), path, "dem")
    return read_pyramid(fx.spark, path, "dem").select("patch", C("level").cast("int").alias("level"), "gx", "gy", "value")


@query("pyr_fill_from_coarser", ora("lattice", f"""
SELECT w.patch, w.gx, w.gy, {S.q('sum(wt*p.value)/sum(wt)')} AS value FROM (
 SELECT patch, gx, gy, least(gx//2,{(N - 1) * 2 ** (L - 1) - 1}) AS x0, least(gy//2,{(N - 1) * 2 ** (L - 1) - 1}) AS y0 FROM lattice WHERE value IS NULL) w,
 (VALUES (0),(1)) AS a(ox), (VALUES (0),(1)) AS b(oy), lv p, (SELECT 1) z, LATERAL (SELECT (1-abs(w.gx/2.0-(x0+ox)))*(1-abs(w.gy/2.0-(y0+oy))) AS wt) q
WHERE wt>0 AND p.patch=w.patch AND p.gx=x0+ox AND p.gy=y0+oy GROUP BY ALL""", f"lv AS (SELECT * FROM {gather_down('lattice', L - 1)})"))
def _(fx):
    """Nodata vertices taken from the level above."""
    coarse = Y.downsample(fx.lattice, N)
    holes = fx.lattice.where(C("value").isNull()).select("patch", "level", "gx", "gy")
    return Y.fill_from_coarser(holes, coarse, N).select("patch", "gx", "gy", quantize(C("value")).alias("value"))
