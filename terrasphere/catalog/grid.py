"""Global grid: lookup, keys, hierarchy and cell geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.geo import sq, vq
from terrasphere.functions import georef, keys, sphere
from terrasphere.functions.descent import refine, with_scope
from terrasphere.functions.patches import base_neighbors, base_scopes
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import grid as G

C = F.col
P = V3.of("p")


def points(fx):
    return put(fx.geo_points, p=sphere.sph_to_cart(F.radians("lon_deg"), F.radians("lat_deg")))


PTS = f"pts AS (SELECT point_id, elev, {S.sph('lon_deg', 'lat_deg', 'p')} FROM geo_points)"
PATCHED = (S.BASE, PTS, S.patch_cte("pts", "point_id", "p"))


def walk(levels: int):
    return (*PATCHED, S.descent_cte("patched", "point_id", "p", levels))


def digits(level: str, path: str, n: int) -> str:
    parts = [f"CASE WHEN {level}>{k} THEN CAST(CAST(floor({path}/{4**k}) AS BIGINT)%4 AS VARCHAR) ELSE '' END" for k in range(n)]
    return "(CASE WHEN " + level + "=0 THEN 'r' ELSE " + "||".join(parts) + " END)"


@query("flagship_cell_summary", ora("geo_points", f"""
SELECT patch, path, {digits('4', 'path', 4)} AS path_text, CAST(count(*) AS BIGINT) AS points, min(elev) AS min_elev, max(elev) AS max_elev,
 {S.q('sum(elev)', 100)} AS sum_elev FROM walk JOIN pts USING (point_id) WHERE level=4 GROUP BY patch, path""", *walk(4), recursive=True))
def _(fx):
    cells = G.with_cell(points(fx), P, 4)
    return (
        cells.groupBy("patch", "level", "path")
        .agg(F.count(F.lit(1)).alias("points"), F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"),
             quantize(F.sum("elev"), 100).alias("sum_elev"))
        .select("patch", "path", keys.path_string(C("level"), C("path")).alias("path_text"), "points", "min_elev",
                "max_elev", "sum_elev"))


@query("grid_base_patches", ora("geo_points", f"""
SELECT patch, CAST(points AS BIGINT) AS points, {sq('a', 'a')}, {sq('d', 'd')} FROM (
 SELECT base.*, coalesce(n,0) AS points FROM base LEFT JOIN (SELECT patch, count(*) AS n FROM patched GROUP BY patch) USING (patch))""", *PATCHED))
def _(fx):
    n = G.with_patch(points(fx), P).groupBy("patch").agg(F.count(F.lit(1)).alias("points"))
    df = base_scopes(fx.spark).join(n, "patch", "left")
    return df.select("patch", F.coalesce("points", F.lit(0)).alias("points"), *vq("a", V3.of("c0")), *vq("d", V3.of("c3")))


_SIDE_SQL = "(VALUES (0,'d','c'),(1,'c','a'),(2,'a','f'),(3,'f','d'))"


@query("grid_base_neighbors", ora("geo_points", f""",
corner AS (SELECT patch, 'a' AS c, ax AS x, ay AS y, az AS z FROM base UNION ALL SELECT patch,'f',fx,fy,fz FROM base
 UNION ALL SELECT patch,'c',cx,cy,cz FROM base UNION ALL SELECT patch,'d',dx,dy,dz FROM base),
edge AS (SELECT s.side, u.patch, u.x AS ux, u.y AS uy, u.z AS uz, v.x AS vx, v.y AS vy, v.z AS vz
 FROM {_SIDE_SQL} AS s(side,c1,c2) JOIN corner u ON u.c=s.c1 JOIN corner v ON v.c=s.c2 AND v.patch=u.patch),
cnt AS (SELECT patch, count(*) AS n FROM patched GROUP BY patch)
SELECT e.patch, e.side, f.patch AS neighbor, CAST((e.side+2-f.side+4)%4 AS INTEGER) AS orientation,
 CAST(coalesce(n.n,0) AS BIGINT) AS neighbor_points
FROM edge e JOIN edge f ON e.ux=f.vx AND e.uy=f.vy AND e.uz=f.vz AND e.vx=f.ux AND e.vy=f.uy AND e.vz=f.uz
LEFT JOIN cnt n ON n.patch=f.patch""".replace(",\ncorner", "SELECT * FROM (WITH corner", 1) + ")", *PATCHED))
def _(fx):
    n = G.with_patch(points(fx), P).groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    b = base_neighbors(fx.spark)
    return b.join(n.withColumnRenamed("patch", "neighbor"), "neighbor", "left").select(
        "patch", "side", "neighbor", "orientation", F.coalesce("n", F.lit(0)).alias("neighbor_points"))


@query("grid_patch_of", ora("geo_points", "SELECT point_id, patch FROM patched", *PATCHED))
def _(fx):
    return G.with_patch(points(fx), P).select("point_id", "patch")


@query("grid_cell_of", ora("geo_points", "SELECT point_id, patch, CAST(level AS INTEGER) AS level, path FROM walk WHERE level=12",
                           *walk(12), recursive=True))
def _(fx):
    return G.with_cell(points(fx), P, 12).select("point_id", "patch", "level", "path")


def cells(fx, level):
    return G.with_cell(points(fx), P, level).select("point_id", "patch", "level", "path")


@query("grid_pack_unpack", ora("geo_points", """
SELECT point_id, (CAST(31 AS BIGINT) | (CAST(patch AS BIGINT)<<5) | ((path>>14)<<10) | (CAST(8 AS BIGINT)<<12) | (path<<18)) AS key,
 31 AS reserved, patch, CAST(path>>14 AS INTEGER) AS child, 8 AS level, path FROM walk WHERE level=8""", *walk(8), recursive=True))
def _(fx):
    df = cells(fx, 8).withColumn("key", keys.pack(C("patch"), C("level"), C("path")))
    return df.select("point_id", "key", *[c.alias(n) for n, c in keys.unpack(C("key")).items()])


@query("grid_parent_child", ora("geo_points", """
SELECT point_id, 5 AS up_level, path%1024 AS up_path, 7 AS down_level, path+2*4096 AS down_path, 0 AS root_level, CAST(0 AS BIGINT) AS root_path
FROM walk WHERE level=6""", *walk(6), recursive=True))
def _(fx):
    up = keys.parent(C("level"), C("path"))
    down = keys.child(C("level"), C("path"), F.lit(2))
    root = keys.parent(F.lit(1), C("path").bitwiseAND(F.lit(3).cast("bigint")))
    return cells(fx, 6).select(
        "point_id", up[0].alias("up_level"), up[1].alias("up_path"), down[0].alias("down_level"), down[1].alias("down_path"),
        root[0].alias("root_level"), root[1].alias("root_path"))


@query("grid_ancestors", ora("geo_points", """
SELECT patch, CAST(level AS INTEGER) AS level, path, CAST(count(*) AS BIGINT) AS points FROM walk GROUP BY ALL""", *walk(6), recursive=True))
def _(fx):
    leaf = cells(fx, 6).groupBy("patch", "level", "path").agg(F.count(F.lit(1)).alias("points"))
    return G.ancestors(leaf).groupBy("patch", "level", "path").agg(F.sum("points").alias("points"))


@query("grid_path_strings", ora("geo_points", f"""
SELECT point_id, {digits('level', 'path', 6)} AS str, 'i|'||CAST(patch AS VARCHAR)||'.'||{digits('level', 'path', 6)} AS med_str,
 'i' AS invalid_str FROM (SELECT * REPLACE (CAST(point_id%7 AS INTEGER) AS level) FROM walk WHERE level=point_id%7)""", *walk(6), recursive=True))
def _(fx):
    df = G.with_cell(points(fx), P, (C("point_id") % 7).cast("int"))
    return df.select(
        "point_id", keys.path_string(C("level"), C("path")).alias("str"),
        keys.med_string(F.lit(31), C("patch"), C("level"), C("path")).alias("med_str"),
        keys.path_string(F.lit(63), C("path")).alias("invalid_str"))


@query("grid_path_steps", ora("geo_points", """
SELECT patch, CAST(k AS INTEGER) AS k, CAST(floor(path/CAST(pow(4,k) AS BIGINT)) AS BIGINT)%4 AS step, CAST(count(*) AS BIGINT) AS points
FROM walk, (SELECT unnest(range(6)) AS k) WHERE level=6 GROUP BY ALL""", *walk(6), recursive=True))
def _(fx):
    return (
        cells(fx, 6).select("patch", F.posexplode(keys.path_steps(C("level"), C("path"))).alias("k", "step"))
        .groupBy("patch", "k", "step").agg(F.count(F.lit(1)).alias("points")))


@query("grid_tile_xy", ora("geo_points", """
SELECT point_id, CAST(sum((CAST(floor(path/pow(4,k)) AS BIGINT)%2)*CAST(pow(2,5-k) AS BIGINT)) AS BIGINT) AS tx,
 CAST(sum((CAST(floor(path/pow(4,k)/2) AS BIGINT)%2)*CAST(pow(2,5-k) AS BIGINT)) AS BIGINT) AS ty, any_value(path) AS path
FROM walk, (SELECT unnest(range(6)) AS k) WHERE level=6 GROUP BY point_id""", *walk(6), recursive=True))
def _(fx):
    df = G.with_tile(cells(fx, 6))
    return df.select("point_id", "tx", "ty", keys.path_of_tile(C("level"), C("tx"), C("ty")).alias("path"))


def occupied(fx, level):
    return G.with_cell(points(fx), P, level).select("patch", "level", "path").distinct()


OCC4 = (*walk(4), S.cells_cte(5), "occ AS (SELECT DISTINCT patch, path FROM walk WHERE level=4)")


@query("grid_split", ora("geo_points", f"""
SELECT c.patch, CAST(c.level AS INTEGER) AS level, c.path, {sq('a', 'a')}, {sq('f', 'f')}, {sq('c', 'c')}, {sq('d', 'd')}
FROM cells c WHERE c.level=5 AND EXISTS (SELECT 1 FROM occ o WHERE o.patch=c.patch AND o.path=c.path%256)""", *OCC4, recursive=True))
def _(fx):
    kids = G.split(with_scope(occupied(fx, 4)))
    out = [c for i, n in enumerate("afcd") for c in vq(n, V3.of(f"c{i}"))]
    return kids.select("patch", "level", "path", *out)


@query("grid_centroid_radius", ora("geo_points", f"""
SELECT patch, path, {sq('m', 'm', 100)}, {S.q(S.norm('a'))} AS radius FROM (
 SELECT *, {S.lin('m0', ('1', 'a'), ('1', 'f'), ('1', 'c'), ('1', 'd'))}, {S.lin('m', (S.R + '/' + S.norm('m0'), 'm0'))} FROM cells
 WHERE level=4 AND (patch, path) IN (SELECT patch, path FROM occ))""", *OCC4, recursive=True))
def _(fx):
    df = with_scope(occupied(fx, 4))
    return df.select("patch", "path", *vq("m", G.centroid(6371000.0), 100), quantize(G.scope_radius()).alias("radius"))


@query("grid_resolution", ora("geo_points", f"""
SELECT patch, path, {S.q('6371000*acos(least(1,' + S.dot('a', 'f') + '))/64', 10)} AS metres FROM cells
WHERE level=4 AND (patch, path) IN (SELECT patch, path FROM occ)""", *OCC4, recursive=True))
def _(fx):
    return with_scope(occupied(fx, 4)).select("patch", "path", quantize(G.resolution(65), 10).alias("metres"))


RES0 = f"(SELECT 6371000*acos({S.dot('a', 'f')})/64 FROM base WHERE patch=0)"
_ILON, _ILAT = "radians(gt0+(12+h)*gt1)", "radians(gt3+(12+h)*gt5)"
IMG_RES = "least(" + S.hav(_ILON, _ILAT, _ILON + "+radians(gt1)", _ILAT) + "," + S.hav(_ILON, _ILAT, _ILON, _ILAT + "+radians(gt5)") + ")"


@query("grid_level_for", ora("images", f"""
SELECT image_id, CAST(min(lv) AS INTEGER) AS level FROM (
 SELECT image_id, {IMG_RES} AS res FROM (SELECT *, CASE WHEN point_sampled THEN 0.0 ELSE 0.5 END AS h FROM images)),
 (SELECT unnest(range(24)) AS lv) WHERE {RES0}/pow(2,lv)<=res*sqrt(2) GROUP BY image_id""", S.BASE))
def _(fx):
    return fx.images.select("image_id", G.level_for(georef.Georef().finest_resolution()).alias("level"))


def adjacent(level: int) -> list[str]:
    """adj(patch, path, side, npatch, npath, nside): cells of a level that share the middle of a side."""
    middles = " UNION ALL ".join(
        f"SELECT patch, path, {side} AS side, {', '.join(S.q(f'{u}{a}+{v}{a}', 1e7) + f' AS m{a}' for a in 'xyz')} FROM cells WHERE level={level}"
        for side, (u, v) in enumerate(("dc", "ca", "af", "fd")))
    return [S.cells_cte(level), f"mid AS ({middles})",
            "adj AS (SELECT e.patch, e.path, e.side, g.patch AS npatch, g.path AS npath, g.side AS nside FROM mid e JOIN mid g ON e.mx=g.mx AND e.my=g.my AND e.mz=g.mz AND (e.patch<>g.patch OR e.path<>g.path))"]


def steps(start: str, sides: list[int], name: str) -> list[str]:
    """Single steps through the given sides (of the first cell's frame) from cell to cell; r counts the turns of the frame."""
    out = []
    for k, side in enumerate(sides):
        out.append(f"{name}{k} AS (SELECT w.point_id, a.npatch AS patch, a.npath AS path, (a.nside+2-{side}+4)%4 AS r FROM {start} w JOIN adj a ON a.patch=w.patch AND a.path=w.path AND a.side=({side}+w.r)%4)")
        start = f"{name}{k}"
    return out


def _at(path: str, level: int, shift: int) -> str:
    """Tile column (shift 0) or row (1) of a path."""
    return "CAST(" + "+".join(f"(({path} >> {2 * k + shift})%2)*{2 ** (level - 1 - k)}" for k in range(level)) + " AS BIGINT)"


def _kin(cells_: str, of: str, level: int) -> str:
    return f"SELECT point_id, {_at('path', level, 0)} AS kin_tx, {_at('path', level, 1)} AS kin_ty, patch AS kin_patch, CAST((4-r)%4 AS INTEGER) AS orientation FROM {cells_} {of}"


# two to the right, one down: beyond both sides by as much only at tx = 62, ty = 0, where the lower side is crossed first
_TIE = f"SELECT point_id FROM k0 WHERE {_at('path', 6, 0)}=62 AND {_at('path', 6, 1)}=0"


@query("grid_kin", ora("geo_points", f"""
{_kin('xy2', f'WHERE point_id NOT IN ({_TIE})', 6)} UNION ALL {_kin('yx2', f'WHERE point_id IN ({_TIE})', 6)}""",
    *walk(6), *adjacent(6), "k0 AS (SELECT point_id, patch, path, 0 AS r FROM walk WHERE level=6)", *steps("k0", [3, 3, 2], "xy"), *steps("k0", [2, 3, 3], "yx"), recursive=True))
def _(fx):
    return G.kin(cells(fx, 6), 2, -1).select("point_id", "kin_tx", "kin_ty", "kin_patch", "orientation")


@query("grid_kin_across", ora("geo_points", """
SELECT k.point_id, k.patch, k.path, w.patch AS kin_patch, w.path AS kin_path, CAST((4-w.r)%4 AS INTEGER) AS orientation FROM k0 k JOIN lf2 w USING (point_id)""",
    *walk(4), *adjacent(4), "k0 AS (SELECT point_id, patch, path, 0 AS r FROM walk WHERE level=4)", *steps("k0", [1, 1, 1], "lf"), recursive=True))
def _(fx):
    return G.kin(cells(fx, 4), -3, 0).select("point_id", "patch", "path", "kin_patch", "kin_path", "orientation")


@query("grid_kin_far", ora("geo_points", """
SELECT point_id, patch AS kin_patch, path AS kin_path, CAST((4-r)%4 AS INTEGER) AS orientation FROM far_ WHERE n=21""",
    *walk(2), *adjacent(2), """far_ AS (SELECT point_id, patch, path, 0 AS r, 0 AS n FROM walk WHERE level=2
 UNION ALL SELECT w.point_id, a.npatch, a.npath, (a.nside+2+4)%4, n+1 FROM far_ w JOIN adj a ON a.patch=w.patch AND a.path=w.path AND a.side=w.r%4 WHERE n<21)""", recursive=True))
def _(fx):
    """Twenty-one cells upward, through five or six sides."""
    return G.kin(cells(fx, 2), 0, 21, crossings=6).select("point_id", "kin_patch", "kin_path", "orientation")


@query("grid_kin_deepest", ora("geo_points", """,
have AS (SELECT DISTINCT patch, level, path FROM walk WHERE level<=5 AND point_id%3=0),
want AS (SELECT point_id, patch, path, unnest(range(6)) AS l FROM walk WHERE level=5)
SELECT w.point_id, CAST(max(w.l) AS INTEGER) AS found_level FROM want w JOIN have h ON h.patch=w.patch AND h.level=w.l AND h.path=w.path%CAST(pow(4,w.l) AS BIGINT)
GROUP BY w.point_id""".replace(",\nhave", "SELECT * FROM (WITH have", 1) + ")", *walk(5), recursive=True))
def _(fx):
    """Existing cells are the pyramid above every third point."""
    df = cells(fx, 5)
    existing = G.ancestors(df.where(C("point_id") % 3 == 0)).select("patch", "level", "path")
    return G.deepest_existing(df, existing, "point_id").select("point_id", C("level").alias("found_level"))


def refine_cte(name: str, depth: int, level: int) -> str:
    """Quads of every tile of a level by recursive midpoints; the middle is the mean of four corners."""
    c = S.cols(*S.CORNERS)
    mids = ", ".join(S.lin(n + "0", ("1", u), ("1", v)) for n, u, v in (("t", "d", "c"), ("l", "c", "a"), ("m", "a", "f"), ("r", "f", "d")))
    o = S.lin("o0", ("1", "a"), ("1", "f"), ("1", "c"), ("1", "d"))
    units = ", ".join(S.unit(n + "0", n) for n in "tlmro")
    return (f"{name} AS (SELECT patch, path, 0 AS k, 0 AS qi, 0 AS qj, {c} FROM cells WHERE level={level}\n UNION ALL SELECT patch, path, k+1, 2*qi+child%2, 2*qj+child//2, {S.pick('child')}\n"
            f"  FROM (SELECT *, {units} FROM (SELECT *, {mids}, {o} FROM {name} WHERE k<{depth})) JOIN (VALUES (0),(1),(2),(3)) AS z(child) ON true)")


_VERTICES = " UNION ALL ".join(f"SELECT patch, path, qi+{dx} AS i, qj+{dy} AS j, {', '.join(f'{u}{a} AS w{a}' for a in 'xyz')} FROM ref WHERE k=4" for u, dx, dy in (("a", 0, 0), ("f", 1, 0), ("c", 0, 1), ("d", 1, 1)))


@query("grid_refine", ora("geo_points", f"""
SELECT patch, path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {sq('v', 'w')} FROM (
 SELECT patch, path, i, j, {', '.join(f'any_value(w{a}) AS w{a}' for a in 'xyz')} FROM ({_VERTICES}) JOIN (SELECT DISTINCT patch, path FROM walk WHERE level=3) USING (patch, path) GROUP BY ALL)""",
    *walk(3), S.cells_cte(3), refine_cte("ref", 4, 3), recursive=True))
def _(fx):
    """17 x 17 lattice of every occupied level-3 cell."""
    v = refine(with_scope(occupied(fx, 3)), 17, ["patch", "path"])
    return v.select("patch", "path", "i", "j", *vq("v", V3.of("")))


def seg_points(fx):
    return put(
        fx.point_pairs,
        p=sphere.sph_to_cart(F.radians("lon_deg"), F.radians("lat_deg")),
        q=sphere.sph_to_cart(F.radians(C("lon_deg") + 5), F.radians(C("lat_deg") * 0.9 + 3)),
    )


SEGS = f"segs AS (SELECT point_id, {S.sph('lon_deg', 'lat_deg', 'p')}, {S.sph('lon_deg+5', 'lat_deg*0.9+3', 'q')} FROM point_pairs)"


_SIDES = ("dc", "ca", "af", "fd")


def side_hits(source: str) -> str:
    """Relation with bounded hits sn<uv> of the ray p -> q on the four sides of corners a f c d.

    Tangents come from normalised up vectors, in nested selects.
    """
    def each(fn):
        return ", ".join(fn(u, v, "n" + u + v) for u, v in _SIDES)
    stages = [
        lambda u, v, n: f"{S.lin('w' + n, ('1', v), ('-1', u))}, {S.cross(u, v, n + '0')}, {S.unit(u, 'u' + n)}, {S.unit(v, 'v' + n)}",
        lambda u, v, n: f"{S.unit(n + '0', n)}, {S.dot('w' + n, 'u' + n)} AS ku{n}, {S.dot('w' + n, 'v' + n)} AS kv{n}",
        lambda u, v, n: f"{S.plane_hit('p', 'e', u, n)} AS t{n}, {S.lin('a' + n, ('1', 'w' + n), (f'-ku{n}', 'u' + n))}, {S.lin('b' + n, ('-1', 'w' + n), (f'kv{n}', 'v' + n))}",
        lambda u, v, n: f"{S.lin('g' + n, ('1', 'p'), (f't{n}', 'e'), ('-1', u))}, {S.lin('h' + n, ('1', 'p'), (f't{n}', 'e'), ('-1', v))}",
        lambda u, v, n: f"CASE WHEN {S.dot('a' + n, 'g' + n)}>=0 AND {S.dot('b' + n, 'h' + n)}>=0 THEN t{n} END AS s{n}",
    ]
    out = f"(SELECT *, {S.lin('e', ('1', 'q'), ('-1', 'p'))} FROM {source})"
    for st in stages:
        out = f"(SELECT *, {each(st)} FROM {out})"
    return out


CROSSED = "coalesce(greatest(sndc,snca,snaf,snfd)>=0 AND least(sndc,snca,snaf,snfd)<=1, false)"


@query("grid_segment_intersects", ora("point_pairs", f"""
SELECT point_id, patch, {CROSSED} AS crossed FROM {side_hits('(SELECT s.*, b.* EXCLUDE (point_id,px,py,pz) FROM segs s JOIN patched b USING (point_id))')}""",
    S.BASE, SEGS, S.patch_cte("segs", "point_id", "p")))
def _(fx):
    df = G.with_patch(seg_points(fx), P)
    scopes = F.broadcast(G.with_side_sections(base_scopes(fx.spark)))  # 30 rows, fixed
    return df.join(scopes, "patch").select("point_id", "patch", G.segment_intersects(P, V3.of("q")).alias("crossed"))


@query("grid_bounding_sphere", ora("geo_points", f"""
SELECT patch, path, {sq('m', 'm', 100)}, {S.q('greatest(' + ','.join('sqrt(' + '+'.join(f'pow({c}{a}*(6371000+{h}*10)-m{a},2)' for a in 'xyz') + ')' for c in 'afcd' for h in ('lo', 'hi')) + ')', 100)} AS r
FROM (SELECT *, {S.lin('m0', ('1', 'a'), ('1', 'f'), ('1', 'c'), ('1', 'd'))}, {S.lin('m', ('(6371000+(lo+hi)*5)/' + S.norm('m0'), 'm0'))} FROM (
 SELECT c.*, coalesce(e.lo,0.0) AS lo, coalesce(e.hi,0.0) AS hi FROM cells c JOIN (
  SELECT patch, path, CASE WHEN path%5=0 THEN NULL ELSE min(elev) END AS lo, max(elev) AS hi_, CASE WHEN path%5=0 THEN NULL ELSE max(elev) END AS hi
  FROM walk JOIN pts USING (point_id) WHERE level=4 GROUP BY patch, path) e ON e.patch=c.patch AND e.path=c.path WHERE c.level=4))""", *OCC4, recursive=True))
def _(fx):
    """Cells with a path divisible by five lose their range, to show the default height."""
    lost = C("path") % 5 == 0
    df = G.with_cell(points(fx), P, 4).groupBy("patch", "level", "path").agg(
        F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"))
    df = df.withColumns({k: F.when(~lost, C(k)) for k in ("min_elev", "max_elev")})
    out = G.bounding_sphere(with_scope(df), vertical_scale=10.0)
    return out.select("patch", "path", *vq("m", V3.of("b"), 100), quantize(C("br"), 100).alias("r"))
