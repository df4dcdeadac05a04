"""Terrain queries over the level-2 height lattice (17 x 17 vertices per tile)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.geo import PAIRS, far, far_columns, pairs, sq, vq
from terrasphere.catalog.grid import P, points, refine_cte, side_hits, walk
from terrasphere.functions import sphere
from terrasphere.functions.patches import base_scopes
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import grid as G
from terrasphere.operators import pyramid as Y
from terrasphere.operators import terrain as T
from terrasphere.plans.build import read_ranges, store
from terrasphere.session import checkpoint_root
from terrasphere.sources.pyramid_store import read_pyramid

C = F.col
N, L = 17, 2


def tiles(fx):
    return Y.tiles_of(fx.terrain, N)


def surface(fx):
    return T.extruded(tiles(fx), fx.terrain, N, 2.0, 0.0)


_TX = "(path%2)*2+(path//4)%2"
_TY = "((path//2)%2)*2+(path//8)%2"
# quads with grown corners; every tile of the lattice is occupied where a vertex exists
_H = ", ".join(f"{u}{a}*(6371000+coalesce(h{u}.value,0)*2) AS {u}{a}" for u in S.CORNERS for a in "xyz")
_J = " ".join(f"LEFT JOIN terrain h{u} ON h{u}.patch=r.patch AND h{u}.gx=r.tx*16+r.qi+{dx} AND h{u}.gy=r.ty*16+r.qj+{dy}"
              for u, dx, dy in (("a", 0, 0), ("f", 1, 0), ("c", 0, 1), ("d", 1, 1)))
SURF = (S.BASE, S.cells_cte(L), refine_cte("ref", 4, L),
        f"occ AS (SELECT DISTINCT patch, gx//16-ox AS tx, gy//16-oy AS ty FROM terrain, (VALUES (0),(1)) AS p(ox), (VALUES (0),(1)) AS q(oy) WHERE (ox=0 OR (gx%16=0 AND gx>0)) AND (oy=0 OR (gy%16=0 AND gy>0)) AND gx//16-ox<=3 AND gy//16-oy<=3)",
        f"quad AS MATERIALIZED (SELECT r.patch, r.path, r.qi, r.qj, {_H} FROM (SELECT *, {_TX} AS tx, {_TY} AS ty FROM ref WHERE k=4) r JOIN occ o ON o.patch=r.patch AND o.tx=r.tx AND o.ty=r.ty {_J})",
        "vtx AS MATERIALIZED (SELECT patch, path, i, j, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM (" + " UNION ALL ".join(
            f"SELECT patch, path, qi+{dx} AS i, qj+{dy} AS j, {u}x AS x, {u}y AS y, {u}z AS z FROM quad" for u, dx, dy in (("a", 0, 0), ("f", 1, 0), ("c", 0, 1), ("d", 1, 1))) + ") GROUP BY ALL)")


@query("ter_extrude", ora("terrain", f"SELECT patch, path, i, j, {S.q('x', 10)} AS x, {S.q('y', 10)} AS y, {S.q('z', 10)} AS z FROM vtx", *SURF, recursive=True))
def _(fx):
    return surface(fx).select("patch", "path", "i", "j", *vq("", V3.of(""), 10))


def _mid(a: str) -> str:
    return f"(a{a}+CASE WHEN k=0 THEN d{a} ELSE f{a} END+CASE WHEN k=0 THEN c{a} ELSE d{a} END)/3"


@query("ter_mesh", ora("terrain", f"""
SELECT patch, path, qi AS cell_x, qj AS cell_y, k AS triangle, {S.q(_mid('x'), 10)} AS mid_x, {S.q(_mid('z'), 10)} AS mid_z
FROM quad JOIN (VALUES (0),(1)) AS t(k) ON true""", *SURF[:-1], recursive=True))
def _(fx):
    tri = T.mesh(T.quads(surface(fx), N))
    mid = lambda a: quantize((C("t0" + a) + C("t1" + a) + C("t2" + a)) / 3, 10)
    return tri.select("patch", "path", C("cx").alias("cell_x"), C("cy").alias("cell_y"), "triangle", mid("x").alias("mid_x"), mid("z").alias("mid_z"))


_X = "(PARTITION BY patch, path, j ORDER BY i)"
_Y = "(PARTITION BY patch, path, i ORDER BY j)"
NORMALS = f"""nrm AS (SELECT patch, path, i, j, {S.unit('m', 'n')} FROM (SELECT patch, path, i, j, {S.cross('e', 'g', 'm')} FROM (
 SELECT patch, path, i, j, {', '.join(f'coalesce(lead({a}) OVER {_X},{a})-coalesce(lag({a}) OVER {_X},{a}) AS e{a}, coalesce(lead({a}) OVER {_Y},{a})-coalesce(lag({a}) OVER {_Y},{a}) AS g{a}' for a in 'xyz')} FROM vtx)))"""


@query("ter_normals", ora("terrain", f"SELECT patch, path, i, j, {sq('n', 'n', 1e5)} FROM nrm", *SURF, NORMALS, recursive=True))
def _(fx):
    return T.normals(surface(fx), N).select("patch", "path", "i", "j", *vq("n", V3.of("n"), 1e5))


@query("ter_hillshade", ora("terrain", f"""
SELECT patch, path, i, j, {S.q('0.2+0.8*greatest(nl,0)+CASE WHEN nl>0 THEN 0.3*pow(greatest((nx*hx+ny*hy+nz*hz)/sqrt(hx*hx+hy*hy+hz*hz),0),8) ELSE 0 END', 1e4)} AS light FROM (
 SELECT *, nx*lx+ny*ly+nz*lz AS nl, lx+0.6 AS hx, ly AS hy, lz+0.8 AS hz FROM (
 SELECT *, sin(radians(135))*cos(radians(40)) AS lx, cos(radians(135))*cos(radians(40)) AS ly, sin(radians(40)) AS lz FROM nrm))""", *SURF, NORMALS, recursive=True))
def _(fx):
    light = T.hillshade(V3.of("n"), 135.0, 40.0, specular=0.3, shininess=8.0, view=V3(0.6, 0.0, 0.8))
    return T.normals(surface(fx), N).select("patch", "path", "i", "j", quantize(light, 1e4).alias("light"))


def _bits(path: str, frm: int, to: int, axis: int) -> str:
    return "+".join(f"(CAST(floor({path}/{4**k * (2 if axis else 1)}) AS BIGINT)%2)*{2 ** (to - 1 - k)}" for k in range(frm, to))


@query("ter_cell_in_tile", ora("geo_points", f"""
SELECT point_id, path%16 AS path, CAST({_bits('path', 2, 6, 0)} AS BIGINT) AS cx, CAST({_bits('path', 2, 6, 1)} AS BIGINT) AS cy FROM walk WHERE level=6""", *walk(6), recursive=True))
def _(fx):
    return T.cell_in_tile(G.with_cell(points(fx), P, L), N).select("point_id", "path", "cx", "cy")


def _cramer(a, b, c):
    return f"({a}x*({b}y*{c}z-{b}z*{c}y)-{b}x*({a}y*{c}z-{a}z*{c}y)+{c}x*({a}y*{b}z-{a}z*{b}y))"


_SNAP = (f"wk AS (SELECT w.point_id, w.patch, w.path%16 AS path, {_bits('path', 2, 6, 0)} AS kx, {_bits('path', 2, 6, 1)} AS ky, px*6371000 AS ox, py*6371000 AS oy, pz*6371000 AS oz, px, py, pz FROM walk w WHERE level=6)",
         f"""sn AS (SELECT point_id, patch, path, kx, ky, k, {S.cols('p')}, {_cramer('e', 'g', 'p')} AS det, {_cramer('w', 'g', 'p')}/det AS u, {_cramer('e', 'w', 'p')}/det AS v, {_cramer('e', 'g', 'w')}/det AS t, la FROM (
 SELECT k.*, z.k, sqrt(q.ax*q.ax+q.ay*q.ay+q.az*q.az) AS la, {', '.join(f'CASE WHEN z.k=0 THEN q.d{a} ELSE q.f{a} END-q.a{a} AS e{a}, CASE WHEN z.k=0 THEN q.c{a} ELSE q.d{a} END-q.a{a} AS g{a}, k.o{a}-q.a{a} AS w{a}' for a in 'xyz')}
 FROM wk k JOIN quad q ON q.patch=k.patch AND q.path=k.path AND q.qi=k.kx AND q.qj=k.ky, (VALUES (0),(1)) AS z(k)))""")


@query("ter_snap", ora("geo_points terrain", f"""
SELECT point_id, path, CAST(any_value(kx) AS BIGINT) AS cell_x, CAST(any_value(ky) AS BIGINT) AS cell_y,
 {S.q("coalesce(6371000-min(CASE WHEN u>=-1e-12 AND v>=-1e-12 AND u+v<=1+1e-12 THEN t END), any_value(la))", 1)} AS radius FROM sn GROUP BY point_id, path""",
    *walk(6), *[s for s in SURF if s != S.BASE], *_SNAP, recursive=True))
def _(fx):
    located = G.with_cell(points(fx), P, L)
    located = put(located, p=P * 6371000.0).join(tiles(fx).select("patch", "level", "path"), ["patch", "level", "path"], "left_semi")
    out = T.snap(located.select("point_id", "patch", "level", "path", "px", "py", "pz"), fx.terrain, N, ["point_id"], 0.0, 2.0)
    return out.select("point_id", "path", C("cx").alias("cell_x"), C("cy").alias("cell_y"), quantize(V3.of("s").norm(), 1).alias("radius"))


_POS = f"pos AS (SELECT point_id, patch, (({_bits('path', 0, 16, 0)})+0.5)*64/65536 AS fx, (({_bits('path', 0, 16, 1)})+0.5)*64/65536 AS fy FROM walk WHERE level=16)"


@query("ter_sample_layer", ora("geo_points terrain", f"""
SELECT point_id, {S.q('sum(w*value)/sum(w)', 1e3)} AS value FROM (SELECT p.point_id, t.value, (1-abs(fx-t.gx))*(1-abs(fy-t.gy)) AS w
 FROM (SELECT * FROM pos, (VALUES (0),(1)) AS a(ox), (VALUES (0),(1)) AS b(oy)) p LEFT JOIN terrain t ON t.patch=p.patch AND t.gx=floor(fx)+ox AND t.gy=floor(fy)+oy AND t.value IS NOT NULL) GROUP BY point_id""",
    *walk(16), _POS, recursive=True))
def _(fx):
    pos = T.lattice_position(points(fx).select("point_id", "px", "py", "pz"), N, L, extra_levels=10)
    out = Y.sample_lattice(pos.select("point_id", "patch", "level", "fx", "fy"), fx.terrain, N, ["point_id"])
    return out.select("point_id", quantize(C("value"), 1e3).alias("value"))


@query("ter_cell_exit", ora("point_pairs", f"""
SELECT point_id, {far('t', 't')}, CASE WHEN t=sfd THEN 3 WHEN t=saf THEN 2 WHEN t=sca THEN 1 WHEN t=sdc THEN 0 END AS side FROM (
 SELECT point_id, CASE WHEN tndc>=0.001 THEN tndc END AS sdc, CASE WHEN tnca>=0.001 THEN tnca END AS sca, CASE WHEN tnaf>=0.001 THEN tnaf END AS saf, CASE WHEN tnfd>=0.001 THEN tnfd END AS sfd,
  least(sdc,sca,saf,sfd) AS t FROM {side_hits('(SELECT s.*, b.* EXCLUDE (point_id,px,py,pz) FROM pq s JOIN patched b USING (point_id))')})""",
    S.BASE, PAIRS, S.patch_cte("pq", "point_id", "p")))
def _(fx):
    """Rays from inside a base patch towards another point, from parameter 0.001 on."""
    df = G.with_patch(pairs(fx), P)
    scopes = F.broadcast(G.with_side_sections(base_scopes(fx.spark)))  # 30 rows, fixed
    t, side = T.cell_exit(P, V3.of("q") - P, F.lit(0.001))
    out = df.join(scopes, "patch").select("point_id", t.alias("t"), side.alias("side"))
    return out.select("point_id", *far_columns(C("t"), "t"), "side")


def _quads(level: int) -> list[str]:
    """Quads m<level> of the stored tiles of one level of the mixed terrain, with grown corners."""
    r = f"rm{level}"
    tx, ty = (f"CAST({_bits('path', 0, level, k)} AS BIGINT)" for k in (0, 1))
    h = ", ".join(f"{u}{a}*(6371000+coalesce(h{u}.value,0)*2) AS {u}{a}" for u in S.CORNERS for a in "xyz")
    j = " ".join(f"LEFT JOIN terrain_mixed h{u} ON h{u}.level={level} AND h{u}.patch=r.patch AND h{u}.gx=r.tx*16+r.qi+{dx} AND h{u}.gy=r.ty*16+r.qj+{dy}"
                 for u, dx, dy in (("a", 0, 0), ("f", 1, 0), ("c", 0, 1), ("d", 1, 1)))
    return [refine_cte(r, 4, level),
            f"st{level} AS (SELECT DISTINCT patch, gx//16 AS tx, gy//16 AS ty FROM terrain_mixed WHERE level={level} AND gx%16<>0 AND gy%16<>0)",
            f"m{level} AS MATERIALIZED (SELECT r.patch, {level} AS level, r.path, r.qi, r.qj, r.tx, r.ty, {h} FROM (SELECT *, {tx} AS tx, {ty} AS ty FROM {r} WHERE k=4) r JOIN st{level} o ON o.patch=r.patch AND o.tx=r.tx AND o.ty=r.ty {j})"]


_RAYS = f"""eye AS (SELECT view_id AS ray_id, {S.sph('eye_lon_deg', 'eye_lat_deg', 'o', 'eye_r')}, {S.sph('eye_lon_deg+7', 'eye_lat_deg*0.9', 'g', '6371000.0*0.9')} FROM views),
ray AS (SELECT ray_id, {S.cols('o')}, {S.unit('d0', 'p')} FROM (SELECT *, {S.lin('d0', ('1', 'g'), ('-1', 'o'))} FROM eye))"""
_MIXED = f"""mix AS MATERIALIZED (SELECT * EXCLUDE (tx, ty) FROM m2 q WHERE NOT EXISTS (SELECT 1 FROM st3 c WHERE c.patch=q.patch AND c.tx=2*q.tx+(CASE WHEN q.qi>=8 THEN 1 ELSE 0 END) AND c.ty=2*q.ty+(CASE WHEN q.qj>=8 THEN 1 ELSE 0 END))
 UNION ALL SELECT * EXCLUDE (tx, ty) FROM m3),
tri AS MATERIALIZED (SELECT patch, level, path, qi, qj, {S.cols('a')}, {', '.join(f'CASE WHEN k=0 THEN d{a} ELSE f{a} END-a{a} AS e{a}, CASE WHEN k=0 THEN c{a} ELSE d{a} END-a{a} AS g{a}' for a in 'xyz')} FROM mix, (VALUES (0),(1)) AS z(k)),
near AS (SELECT ray_id, t.*, {S.cols('p')}, {', '.join(f'o{a}-a{a} AS w{a}' for a in 'xyz')} FROM ray, tri t WHERE abs((ax-ox)*(py*1.0)-(ay-oy)*px)<1e6 AND abs((ay-oy)*pz-(az-oz)*py)<1e6 AND abs((ax-ox)*pz-(az-oz)*px)<1e6)"""


_HITS = ora("terrain_mixed views", f"""
SELECT ray_id, {S.q('min(t)', 1)} AS t, arg_min(patch,t) AS patch, CAST(arg_min(level,t) AS INTEGER) AS level, arg_min(path,t) AS path, CAST(arg_min(qi,t) AS BIGINT) AS cx, CAST(arg_min(qj,t) AS BIGINT) AS cy FROM (
 SELECT *, -{_cramer('e', 'g', 'p')} AS det, -({_cramer('w', 'g', 'p')})/det AS u, -({_cramer('e', 'w', 'p')})/det AS v, {_cramer('e', 'g', 'w')}/det AS t FROM near)
 WHERE det>0 AND u>=-1e-12 AND v>=-1e-12 AND u+v<=1+1e-12 AND t>=0 GROUP BY ray_id""", S.BASE, S.cells_cte(3), *_quads(2), *_quads(3), _RAYS, _MIXED, recursive=True)


def view_rays(fx):
    v = put(fx.views.select(C("view_id").alias("ray_id"), "eye_lon_deg", "eye_lat_deg", "eye_r"),
            o=sphere.sph_to_cart(F.radians("eye_lon_deg"), F.radians("eye_lat_deg"), C("eye_r")),
            g=sphere.sph_to_cart(F.radians(C("eye_lon_deg") + 7), F.radians(C("eye_lat_deg") * 0.9), F.lit(6371000.0 * 0.9)))
    return put(v, d=(V3.of("g") - V3.of("o")).unit())


@query("ter_intersect", _HITS)
def _(fx):
    """Rays of all views towards a point below the horizon of their eye, over terrain of two depths."""
    out = T.intersect(view_rays(fx), fx.terrain_mixed, N, vertical_scale=2.0)
    return out.select("ray_id", quantize(C("t"), 1).alias("t"), "patch", "level", "path", "cx", "cy")


@query("ter_intersect_stored", _HITS)
def _(fx):
    """The same rays against a stored dataset, pruned by the ranges that it keeps."""
    path = f"{checkpoint_root(fx.spark)}/terrain-{uuid.uuid4().hex}"
    store(fx.spark, fx.terrain_mixed, path, N)
    out = T.intersect(view_rays(fx), read_pyramid(fx.spark, path), N, vertical_scale=2.0, ranges=read_ranges(fx.spark, path))
    return out.select("ray_id", quantize(C("t"), 1).alias("t"), "patch", "level", "path", "cx", "cy")


# points over the terrain of two depths: the tile of level 3 where it is stored, else that of level 2
_MSNAP = (f"""wkm AS (SELECT w.point_id, w.patch, CASE WHEN s.tx IS NULL THEN 2 ELSE 3 END AS level, CASE WHEN s.tx IS NULL THEN path%16 ELSE path%64 END AS path,
 CAST(CASE WHEN s.tx IS NULL THEN {_bits('path', 2, 6, 0)} ELSE {_bits('path', 3, 7, 0)} END AS BIGINT) AS kx, CAST(CASE WHEN s.tx IS NULL THEN {_bits('path', 2, 6, 1)} ELSE {_bits('path', 3, 7, 1)} END AS BIGINT) AS ky,
 px*6371000 AS ox, py*6371000 AS oy, pz*6371000 AS oz, px, py, pz FROM walk w LEFT JOIN st3 s ON s.patch=w.patch AND s.tx=CAST({_bits('path', 0, 3, 0)} AS BIGINT) AND s.ty=CAST({_bits('path', 0, 3, 1)} AS BIGINT) WHERE w.level=7)""",
          f"""snm AS (SELECT point_id, level, path, kx, ky, k, {S.cols('p')}, {_cramer('e', 'g', 'p')} AS det, {_cramer('w', 'g', 'p')}/det AS u, {_cramer('e', 'w', 'p')}/det AS v, {_cramer('e', 'g', 'w')}/det AS t, la FROM (
 SELECT k.*, z.k, sqrt(q.ax*q.ax+q.ay*q.ay+q.az*q.az) AS la, {', '.join(f'CASE WHEN z.k=0 THEN q.d{a} ELSE q.f{a} END-q.a{a} AS e{a}, CASE WHEN z.k=0 THEN q.c{a} ELSE q.d{a} END-q.a{a} AS g{a}, k.o{a}-q.a{a} AS w{a}' for a in 'xyz')}
 FROM wkm k JOIN (SELECT * FROM m2 UNION ALL SELECT * FROM m3) q ON q.patch=k.patch AND q.level=k.level AND q.path=k.path AND q.qi=k.kx AND q.qj=k.ky, (VALUES (0),(1)) AS z(k)))""")


@query("ter_snap_mixed", ora("geo_points terrain_mixed", f"""
SELECT point_id, CAST(level AS INTEGER) AS level, path, any_value(kx) AS cell_x, any_value(ky) AS cell_y,
 {S.q("coalesce(6371000-min(CASE WHEN u>=-1e-12 AND v>=-1e-12 AND u+v<=1+1e-12 THEN t END), any_value(la))", 1)} AS radius FROM snm GROUP BY point_id, level, path""",
    *walk(7), S.cells_cte(3), *_quads(2), *_quads(3), *_MSNAP, recursive=True))
def _(fx):
    """Points find their own finest tile and snap to it."""
    p = put(points(fx), p=P * 6371000.0).select("point_id", "px", "py", "pz")
    located = T.with_finest(p, T.stored_tiles(fx.terrain_mixed, N), ["point_id"], 3)
    out = T.snap(located, fx.terrain_mixed, N, ["point_id"], 0.0, 2.0)
    return out.select("point_id", "level", "path", C("cx").alias("cell_x"), C("cy").alias("cell_y"), quantize(V3.of("s").norm(), 1).alias("radius"))


@query("ter_probe_range", ora("pixels", """
SELECT image_id, CASE WHEN odd THEN v1 ELSE coalesce(v1,0.0) END AS range_min, CASE WHEN odd THEN 50+v1-0 ELSE coalesce(v2,50.0) END AS range_max FROM (
 SELECT image_id, any_value(probe)%2=1 AS odd, CASE WHEN odd THEN max(value) ELSE max(value) FILTER (sid=1) END AS v1, max(value) FILTER (sid=2) AS v2 FROM (
  SELECT image_id, px AS probe, CASE WHEN px%2=1 THEN 1 ELSE 1+py%2 END AS sid, max(value) AS value FROM pixels p WHERE value<>1 AND px=(SELECT max(px) FROM pixels z WHERE z.image_id=p.image_id AND z.value<>1) GROUP BY ALL) GROUP BY image_id)"""))
def _(fx):
    """Columns of an image act as probes: odd ones have one sample, even ones two."""
    odd = C("px") % 2 == 1
    s = fx.pixels.where(C("value") != 1).groupBy(
        "image_id", C("px").alias("probe"), F.when(odd, 1).otherwise(1 + C("py") % 2).alias("sample_id")).agg(F.max("value").alias("value"))
    s = s.withColumn("num_samples", F.when(C("probe") % 2 == 1, 1).otherwise(2))
    ranges = fx.pixels.select("image_id").distinct().select("image_id", F.lit(0.0).alias("range_min"), F.lit(50.0).alias("range_max"))
    return T.probe_range(s, ranges, "image_id")


@query("ter_to_lonlat_elev", ora("geo_points", f"SELECT point_id, {S.q('lon_deg', 1e4)} AS lon, {S.q('lat_deg', 1e4)} AS lat, {S.q('elev', 100)} AS elev FROM geo_points"))
def _(fx):
    df = put(fx.geo_points.withColumnRenamed("elev", "e"), v=sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("e") * 4.0))
    lon, lat, elev = T.to_lonlat_elev(V3.of("v"), 4.0)
    return df.select("point_id", quantize(lon, 1e4).alias("lon"), quantize(lat, 1e4).alias("lat"), quantize(elev, 100).alias("elev"))
