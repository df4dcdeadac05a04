"""View-dependent selection and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.coverage import COV, bridge, existing, line_segments
from terrasphere.catalog.grid import P, points, walk
from terrasphere.functions import sphere
from terrasphere.functions.descent import with_scope
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import grid as G
from terrasphere.operators import lod, quality

C = F.col
R = 6371000.0
SCREEN = 800.0


def all_views(fx):
    v = put(fx.views, e=sphere.sph_to_cart(F.radians("eye_lon_deg"), F.radians("eye_lat_deg"), C("eye_r")),
            f=sphere.sph_to_cart(F.radians("eye_lon_deg"), F.radians("eye_lat_deg"), F.lit(R)))
    v = lod.frustum(v, 20.0, 1000.0, 4 * R)
    return v.select("view_id", "ex", "ey", "ez", "fx", "fy", "fz", "focus_radius", "planes")


def tree(fx, level=3):
    """Bounding spheres of the cell tree over all points."""
    cells = G.ancestors(G.with_cell(points(fx), P, level).select("patch", "level", "path", "elev"))
    agg = cells.groupBy("patch", "level", "path").agg(F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"))
    return G.bounding_sphere(with_scope(agg)).select("patch", "level", "path", "bx", "by", "bz", "br")


TREE = (*walk(3), f"""rng AS (SELECT patch, level, path, min(elev) AS lo, max(elev) AS hi FROM walk JOIN pts USING (point_id) GROUP BY ALL)""", S.cells_cte(3),
        f"""bnd AS (SELECT patch, level, path, {S.cols('m')}, greatest({','.join('sqrt(' + '+'.join(f'pow({c}{a}*(6371000+{h})-m{a},2)' for a in 'xyz') + ')' for c in S.CORNERS for h in ('lo', 'hi'))}) AS br FROM (
 SELECT *, {S.lin('m', ('(6371000+(lo+hi)/2)/' + S.norm('m0'), 'm0'))} FROM (SELECT c.*, r.lo, r.hi, {S.lin('m0', ('1', 'a'), ('1', 'f'), ('1', 'c'), ('1', 'd'))} FROM cells c JOIN rng r ON r.patch=c.patch AND r.level=c.level AND r.path=c.path)))""",
        f"""eye AS (SELECT view_id, focus_radius, {S.sph('eye_lon_deg', 'eye_lat_deg', 'e', 'eye_r')}, {S.sph('eye_lon_deg', 'eye_lat_deg', 'f', S.R)} FROM views)""",
        f"""fru AS (SELECT *, {S.cross('r', 'd', 'u')} FROM (SELECT *, {S.unit('r0', 'r')} FROM (SELECT *, CASE WHEN abs(dz)<0.9 THEN dy ELSE 0.0 END AS r0x, CASE WHEN abs(dz)<0.9 THEN -dx ELSE dz END AS r0y, CASE WHEN abs(dz)<0.9 THEN 0.0 ELSE -dy END AS r0z
 FROM (SELECT *, {S.unit('d0', 'd')} FROM (SELECT *, {S.lin('d0', ('1', 'f'), ('-1', 'e'))} FROM eye)))))""",
        f"""ev AS (SELECT *, dep+br>=1000 AND dep-br<={4 * R} AND {' AND '.join(f'{sg}{v}*cos(radians(20))+dep*sin(radians(20))>=-br' for v in ('lr', 'lu') for sg in ('', '-'))} AS visible,
  ln((CASE WHEN de<=br THEN 3.4028234663852886e38 WHEN df>focus_radius THEN br*{SCREEN}/de/pow(df/focus_radius,2) ELSE br*{SCREEN}/de END)/(65*0.55)) AS lod FROM (
  SELECT view_id, focus_radius, patch, level, path, br, {S.cols('m', 'e')}, {S.dot('z', 'd')} AS dep, {S.dot('z', 'r')} AS lr, {S.dot('z', 'u')} AS lu, {S.norm('z')} AS de, sqrt(pow(mx-fx,2)+pow(my-fy,2)+pow(mz-fz,2))-br AS df
  FROM (SELECT *, {S.lin('z', ('1', 'm'), ('-1', 'e'))} FROM bnd, fru)))""")


_CUT = """kid AS (SELECT patch, level-1 AS level, path%CAST(pow(4,level-1) AS BIGINT) AS path, count(*) AS kids FROM rng WHERE level>0 GROUP BY ALL),
evk AS (SELECT e.*, coalesce(k.kids,0) AS kids FROM ev e LEFT JOIN kid k ON k.patch=e.patch AND k.level=e.level AND k.path=e.path),
spl AS (SELECT view_id, patch, level, path, visible AND lod>THR AND kids=4 AS sp FROM evk),
met AS (SELECT e.* FROM evk e WHERE (SELECT coalesce(bool_and(s.sp),true) FROM spl s WHERE s.view_id=e.view_id AND s.patch=e.patch AND s.level<e.level AND s.path=e.path%CAST(pow(4,s.level) AS BIGINT))),
cutt AS (SELECT * FROM met WHERE NOT (visible AND lod>THR AND kids=4))"""


def cut_sql(thr: str) -> str:
    return _CUT.replace("THR", thr)


@query("lod_visible", ora("geo_points views", "SELECT view_id, patch, CAST(level AS INTEGER) AS level, path, visible FROM met", *TREE, cut_sql("1.0"), recursive=True))
def _(fx):
    """Every cell that a view meets on its way down to its cut."""
    df = lod.reached(tree(fx), all_views(fx), lambda: lod.value(SCREEN), 1.0)
    return df.select("view_id", "patch", "level", "path", "visible")


@query("lod_value", ora("geo_points views", f"SELECT view_id, patch, CAST(level AS INTEGER) AS level, path, {S.q('2*lod+0.5', 1e4)} AS lod FROM met", *TREE, cut_sql("0.25"), recursive=True))
def _(fx):
    df = lod.reached(tree(fx), all_views(fx), lambda: lod.value(SCREEN, 2.0, 0.5), 1.0)
    return df.select("view_id", "patch", "level", "path", quantize(C("lod"), 1e4).alias("lod"))


@query("lod_cut", ora("geo_points views", f"SELECT view_id, patch, CAST(level AS INTEGER) AS level, path, visible, {S.q('lod', 1e4)} AS lod FROM cutt", *TREE, cut_sql("1.0"), recursive=True))
def _(fx):
    out = lod.cut(tree(fx), all_views(fx), lambda: lod.value(SCREEN), 1.0)
    return out.select("view_id", "patch", "level", "path", "visible", quantize(C("lod"), 1e4).alias("lod"))


@query("lod_order_by_distance", ora("geo_points views", f"""
SELECT view_id, patch, CAST(level AS INTEGER) AS level, path, CAST(row_number() OVER (PARTITION BY view_id ORDER BY de DESC, patch, level, path) AS BIGINT) AS rank, {S.q('de', 1)} AS dist FROM cutt WHERE visible""", *TREE, cut_sql("1.0"), recursive=True))
def _(fx):
    """The visible cells of every view's cut, farthest first."""
    front = lod.cut(tree(fx), all_views(fx), lambda: lod.value(SCREEN), 1.0).where("visible")
    return lod.order_by_distance(front).select("view_id", "patch", "level", "path", "rank", quantize(C("dist"), 1).alias("dist"))


_MISS = """miss AS (SELECT e.view_id, e.patch, e.level+1 AS level, e.path+k.c*CAST(pow(4,e.level) AS BIGINT) AS path, k.c AS child, e.lod FROM cutt e, (VALUES (0),(1),(2),(3)) AS k(c)
 WHERE e.visible AND e.lod>0.5 AND NOT EXISTS (SELECT 1 FROM rng r WHERE r.patch=e.patch AND r.level=e.level+1 AND r.path=e.path+k.c*CAST(pow(4,e.level) AS BIGINT)))"""


def missing(fx):
    t = tree(fx)
    df = lod.cut(t, all_views(fx), lambda: lod.value(SCREEN), 0.5).where(C("visible") & (C("lod") > 0.5))
    return lod.missing_tiles(df.select("view_id", "patch", "level", "path", "lod"), t)


@query("lod_missing_tiles", ora("geo_points views", "SELECT view_id, patch, CAST(level AS INTEGER) AS level, path, child FROM miss", *TREE, cut_sql("0.5"), _MISS, recursive=True))
def _(fx):
    return missing(fx).select("view_id", "patch", "level", "path", "child")


@query("lod_coalesce_requests", ora("geo_points views", f"""
SELECT patch, CAST(level AS INTEGER) AS level, path, CAST(row_number() OVER (ORDER BY abs(lod), patch, level, path) AS INTEGER) AS rank, {S.q('lod', 1e4)} AS lod FROM (
 SELECT patch, level, path, min(lod) AS lod FROM miss GROUP BY ALL) QUALIFY rank<=8""", *TREE, cut_sql("0.5"), _MISS, recursive=True))
def _(fx):
    """The default bound of eight pending requests."""
    return lod.coalesce_requests(missing(fx), 8).select("patch", "level", "path", "rank", quantize(C("lod"), 1e4).alias("lod"))


@query("qa_tile_stats", ora("geo_points line_points", """
SELECT CAST(count(*) AS BIGINT) AS tiles, CAST(count(n) AS BIGINT) AS tiles_with_lines, CAST(sum(n) AS BIGINT) AS segments, CAST(max(n) AS BIGINT) AS max_segments
FROM have LEFT JOIN (SELECT patch, level, path, count(*) AS n FROM lcov GROUP BY ALL) USING (patch, level, path)""", *COV, recursive=True))
def _(fx):
    return quality.tile_stats(existing(fx), bridge(fx))


@query("qa_verify_tree", ora("geo_points", """
SELECT coalesce(a.patch,b.patch) AS patch, CAST(coalesce(a.level,b.level) AS INTEGER) AS level, coalesce(a.path,b.path) AS path,
 CASE WHEN a.patch IS NULL THEN 'missing parent' ELSE 'missing children' END AS problem
FROM broken a FULL JOIN (SELECT patch, level-1 AS level, path%CAST(pow(4,level-1) AS BIGINT) AS path, count(*) AS kids FROM broken WHERE level>0 GROUP BY ALL) b
 ON a.patch=b.patch AND a.level=b.level AND a.path=b.path WHERE a.patch IS NULL OR b.kids<4""", *walk(4),
    "broken AS (SELECT DISTINCT patch, level, path FROM walk WHERE NOT (level=2 AND path%5=0))", recursive=True))
def _(fx):
    """A tree whose level-2 cells with a path divisible by five were lost."""
    t = existing(fx, 4).where(~((C("level") == 2) & (C("path") % 5 == 0)))
    return quality.verify_tree(t)


@query("qa_verify_coverage", ora("geo_points line_points", """
SELECT line_id, seg, patch, CAST(level AS INTEGER) AS level, path, 'unknown segment' AS problem FROM lcov WHERE line_id%50=7
UNION ALL SELECT line_id, seg, patch, CAST(level AS INTEGER), path, 'duplicate' FROM lcov WHERE line_id%50=9
UNION ALL SELECT line_id, seg, patch, CAST(level AS INTEGER), path, 'removed segment' FROM lcov WHERE line_id%50=11""", *COV, recursive=True))
def _(fx):
    """A bridge with rows of deleted lines, duplicates, and rows that should have been removed."""
    b = bridge(fx).drop("is_leaf")
    twice = b.unionByName(b.where(C("line_id") % 50 == 9))
    segs = line_segments(fx)
    return quality.verify_coverage(twice, segs.where(C("line_id") % 50 != 7), segs.where(C("line_id") % 50 == 11))
