"""Coverage predicates and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.grid import CROSSED, IMG_RES, RES0, P, points, side_hits, walk
from terrasphere.functions import georef
from terrasphere.functions.descent import with_scope
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import cover, coverage
from terrasphere.operators import grid as G
from terrasphere.operators import lines as L
from terrasphere.operators import pyramid as Y

C = F.col

EDGES = """edges AS (SELECT poly_id, ord, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
 FROM polygons WINDOW w AS (PARTITION BY poly_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def crossing(px: str, py: str, e: str = "e") -> str:
    return (f"(CASE WHEN ({e}.y<={py} AND {e}.y2>{py} AND ({px}-{e}.x)*({e}.y2-{e}.y)<({py}-{e}.y)*({e}.x2-{e}.x)) OR "
            f"({e}.y>{py} AND {e}.y2<={py} AND ({px}-{e}.x2)*({e}.y-{e}.y2)<({py}-{e}.y2)*({e}.x-{e}.x2)) THEN 1 ELSE 0 END)")


@query("cov_point_in_polygon", ora("geo_points polygons", f"""
SELECT point_id, poly_id FROM geo_points, edges e GROUP BY point_id, poly_id HAVING sum({crossing('lon_deg', 'lat_deg')})%2=1""", EDGES))
def _(fx):
    pts = fx.geo_points.select("point_id", C("lon_deg").alias("px"), C("lat_deg").alias("py"))
    return coverage.point_in_polygon(pts, fx.polygons, "point_id", "poly_id")


BOXES = "boxes AS (SELECT image_id, gt0 AS bx0, gt3-12 AS by0, gt0+12 AS bx1, gt3 AS by1 FROM images)"


def _clip(p: str, c: str, lo: str, hi: str):
    enter = (f"greatest(CASE WHEN {p}<{lo} THEN CASE WHEN {c}>={lo} THEN ({lo}-{p})/({c}-{p}) ELSE 1 END ELSE 0 END,"
             f"CASE WHEN {p}>{hi} THEN CASE WHEN {c}<={hi} THEN ({hi}-{p})/({c}-{p}) ELSE 1 END ELSE 0 END)")
    leave = (f"least(CASE WHEN {p}>={lo} AND {c}<{lo} THEN ({lo}-{p})/({c}-{p}) ELSE 1 END,"
             f"CASE WHEN {p}<={hi} AND {c}>{hi} THEN ({hi}-{p})/({c}-{p}) ELSE 1 END)")
    return enter, leave


_ex, _lx = _clip("e.x", "e.x2", "bx0", "bx1")
_ey, _ly = _clip("e.y", "e.y2", "by0", "by1")


@query("cov_polygon_box", ora("images polygons", f"""
SELECT * FROM (SELECT poly_id, image_id, CASE WHEN bool_or(greatest(0,{_ex},{_ey})<least(1,{_lx},{_ly})) THEN 'OVERLAPS'
 WHEN sum({crossing('bx0', 'by0')})%2=1 THEN 'CONTAINS' ELSE 'SEPARATE' END AS relation FROM edges e, boxes GROUP BY poly_id, image_id)
WHERE relation<>'SEPARATE'""", EDGES, BOXES))
def _(fx):
    boxes = fx.images.select("image_id", C("gt0").alias("bx0"), (C("gt3") - 12).alias("by0"), (C("gt0") + 12).alias("bx1"), C("gt3").alias("by1"))
    return coverage.polygon_box(fx.polygons, boxes, "poly_id", "image_id")


# outlines of images as polygons; a third of them are small and may lie inside a polygon
QUADS = """quads AS (SELECT image_id, v.ord AS ord, gt0+shift+v.x*s AS x, gt3-12+v.y*s AS y FROM (
  SELECT image_id, gt0, gt3, CASE WHEN image_id%3=0 THEN 2.0 ELSE 12.0 END AS s, SHIFT AS shift FROM images),
 (VALUES (0,0.0,0.0),(1,1.0,0.0),(2,1.0,1.0),(3,0.0,1.0)) AS v(ord,x,y)),
qe AS (SELECT image_id, ord, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
 FROM quads WINDOW w AS (PARTITION BY image_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def quads(fx, shift=0.0):
    s = F.when(C("image_id") % 3 == 0, F.lit(2.0)).otherwise(F.lit(12.0))
    corners = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), (C("gt0") + shift + s * x).alias("x"), (C("gt3") - 12 + s * y).alias("y"))
                     for i, (x, y) in enumerate(corners)])
    return fx.images.select("image_id", F.inline(rows))


def _orient(a, b, c):
    return f"(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


def relation_ctes(dx: str, dy: str, suffix: str) -> tuple[str, ...]:
    """Pairwise relation by orientation tests, with the second polygon moved by dx, dy."""
    a, b = ("e.x", "e.y"), ("e.x2", "e.y2")
    c, d = (f"(f.x+{dx})", f"(f.y+{dy})"), (f"(f.x2+{dx})", f"(f.y2+{dy})")
    o = [_orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)]
    boxed = (f"greatest(least({a[0]},{b[0]}),least({c[0]},{d[0]}))<=least(greatest({a[0]},{b[0]}),greatest({c[0]},{d[0]})) AND "
             f"greatest(least({a[1]},{b[1]}),least({c[1]},{d[1]}))<=least(greatest({a[1]},{b[1]}),greatest({c[1]},{d[1]}))")
    return (
        f"""ov{suffix} AS (SELECT DISTINCT poly_id, image_id FROM edges e, qe f WHERE {boxed} AND {o[0]}*{o[1]}<=0 AND {o[2]}*{o[3]}<=0)""",
        f"""qin{suffix} AS (SELECT poly_id, image_id FROM (SELECT e.poly_id, v.image_id, v.ord, sum({crossing(f'(v.x+{dx})', f'(v.y+{dy})')})%2 AS ins
 FROM quads v, edges e GROUP BY ALL) GROUP BY poly_id, image_id HAVING min(ins)=1)""",
        f"""pin{suffix} AS (SELECT poly_id, image_id FROM (SELECT v.poly_id, e.image_id, v.ord, sum({crossing(f'(v.x-{dx})', f'(v.y-{dy})')})%2 AS ins
 FROM polygons v, qe e GROUP BY ALL) GROUP BY poly_id, image_id HAVING min(ins)=1)""",
        f"""rel{suffix} AS (SELECT poly_id, image_id, CASE min(r) WHEN 0 THEN 'OVERLAPS' WHEN 1 THEN 'CONTAINS' ELSE 'ISCONTAINED' END AS relation FROM (
 SELECT *, 0 AS r FROM ov{suffix} UNION ALL SELECT *, 1 FROM qin{suffix} UNION ALL SELECT *, 2 FROM pin{suffix}) GROUP BY ALL)""")


@query("cov_polygon_polygon", ora("images polygons", "SELECT * FROM rel", EDGES, QUADS.replace("SHIFT", "0.0"), *relation_ctes("0.0", "0.0", "")))
def _(fx):
    return coverage.polygon_polygon(fx.polygons, quads(fx), "poly_id", "image_id")


# the polygons in three sizes: some of 1e-4 degrees, some of several hundred
MIXED = """mixed AS (SELECT poly_id, ord, ax+(x-ax)*f AS x, ay+(y-ay)*f AS y FROM (
 SELECT *, CAST((poly_id*41)%340-175 AS DOUBLE) AS ax, CAST((poly_id*59)%150-80 AS DOUBLE) AS ay, CASE poly_id%5 WHEN 0 THEN CAST(0.00001 AS DOUBLE) WHEN 1 THEN CAST(28 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS f FROM polygons))"""
MIXED_EDGES = EDGES.replace("FROM polygons", "FROM mixed")


def mixed(fx):
    ax, ay = ((C("poly_id") * 41) % 340 - 175).cast("double"), ((C("poly_id") * 59) % 150 - 80).cast("double")
    f = F.when(C("poly_id") % 5 == 0, F.lit(0.00001)).when(C("poly_id") % 5 == 1, F.lit(28.0)).otherwise(F.lit(1.0))
    return fx.polygons.select("poly_id", "ord", (ax + (C("x") - ax) * f).alias("x"), (ay + (C("y") - ay) * f).alias("y"))


@query("cov_point_in_polygon_mixed", ora("geo_points polygons", f"""
SELECT point_id, poly_id FROM geo_points, edges e GROUP BY point_id, poly_id HAVING sum({crossing('lon_deg', 'lat_deg')})%2=1""", MIXED, MIXED_EDGES))
def _(fx):
    pts = fx.geo_points.select("point_id", C("lon_deg").alias("px"), C("lat_deg").alias("py"))
    return coverage.point_in_polygon(pts, mixed(fx), "point_id", "poly_id")


@query("cov_polygon_box_mixed", ora("images polygons", f"""
SELECT * FROM (SELECT poly_id, image_id, CASE WHEN bool_or(greatest(0,{_ex},{_ey})<least(1,{_lx},{_ly})) THEN 'OVERLAPS'
 WHEN sum({crossing('bx0', 'by0')})%2=1 THEN 'CONTAINS' ELSE 'SEPARATE' END AS relation FROM edges e, boxes GROUP BY poly_id, image_id)
WHERE relation<>'SEPARATE'""", MIXED, MIXED_EDGES, BOXES))
def _(fx):
    boxes = fx.images.select("image_id", C("gt0").alias("bx0"), (C("gt3") - 12).alias("by0"), (C("gt0") + 12).alias("bx1"), C("gt3").alias("by1"))
    return coverage.polygon_box(mixed(fx), boxes, "poly_id", "image_id")


@query("cov_polygon_polygon_mixed", ora("images polygons", "SELECT * FROM rel", MIXED, MIXED_EDGES, QUADS.replace("SHIFT", "0.0"),
    *[c.replace("FROM polygons v", "FROM mixed v") for c in relation_ctes("0.0", "0.0", "")]))
def _(fx):
    return coverage.polygon_polygon(mixed(fx), quads(fx), "poly_id", "image_id")


_SH = [("0.0", "0.0"), ("360.0", "0.0"), ("0.0", "180.0"), ("360.0", "180.0")]


@query("cov_periodic_overlap", ora("images polygons", """
SELECT poly_id, image_id, arg_min(relation, k) AS relation, CAST(min(k) AS INTEGER) AS shift FROM (""" + " UNION ALL ".join(
    f"SELECT *, {i} AS k FROM rel{i}" for i in range(4)) + ") GROUP BY poly_id, image_id",
    EDGES, QUADS.replace("SHIFT", "CASE WHEN image_id%2=0 THEN -360.0 ELSE 0.0 END"), *[c for i, (x, y) in enumerate(_SH) for c in relation_ctes(x, y, str(i))]))
def _(fx):
    """Every second image is stored one turn to the west."""
    moved = quads(fx).withColumn("x", C("x") - F.when(C("image_id") % 2 == 0, F.lit(360.0)).otherwise(F.lit(0.0)))
    return coverage.periodic_overlap(fx.polygons, moved, "poly_id", "image_id")


_ENDS = (("a", "f"), ("f", "d"), ("d", "c"), ("c", "a"))  # bottom, right, top, left
_PER = "(PARTITION BY patch, level, path ORDER BY ord)"
RINGS = (
    "bd AS (" + " UNION ALL ".join(f"SELECT patch, level, path, {k} AS side, 0 AS k, 0 AS i, {', '.join(f'{u}{x} AS s{x}, {v}{x} AS e{x}' for x in 'xyz')} FROM ring_cells" for k, (u, v) in enumerate(_ENDS))
    + f"""\n UNION ALL SELECT patch, level, path, side, k+1, 2*i+h, {', '.join(f'CASE WHEN h=0 THEN s{x} ELSE m{x} END, CASE WHEN h=0 THEN m{x} ELSE e{x} END' for x in 'xyz')}
 FROM (SELECT *, {S.unit('n', 'm')} FROM (SELECT *, {S.lin('n', ('1', 's'), ('1', 'e'))} FROM bd WHERE k<3)), (VALUES (0),(1)) AS z(h))""",
    """bv AS (SELECT patch, level, path, side*8+i AS ord, atan2(sy,sx) AS lon, asin(greatest(-1.0,least(1.0,sz))) AS lat, abs(pi()/2-abs(asin(greatest(-1.0,least(1.0,sz)))))<1e-5 AS pole FROM bd WHERE k=3)""",
    f"""be AS (SELECT *, last_value(CASE WHEN pole AND ord>0 THEN NULL ELSE lon END IGNORE NULLS) OVER {_PER} AS eff, lag(pole) OVER {_PER} AS left_pole, lag(lat) OVER {_PER} AS before FROM bv)""",
    f"""bt AS (SELECT *, -round((eff-lag(eff) OVER {_PER})/(2*pi())) AS turn FROM be)""",
    f"""bu AS (SELECT *, eff+2*pi()*coalesce(sum(turn) OVER {_PER},0) AS u FROM bt)""",
    """bs AS (SELECT *, u-CASE WHEN max(u) OVER (PARTITION BY patch, level, path)>pi() THEN 2*pi() ELSE 0 END AS w FROM bu)""",
    """tv AS (SELECT patch, level, path, CAST(row_number() OVER (PARTITION BY patch, level, path ORDER BY ord, part)-1 AS INTEGER) AS ord, w AS x, lat AS y FROM (
 SELECT patch, level, path, ord, 1 AS part, w, lat FROM bs UNION ALL SELECT patch, level, path, ord, 0, w, before FROM bs WHERE left_pole))""",
)


@query("cov_scope_footprint", ora("geo_points", f"""
SELECT patch, path, ord, {S.q('x')} AS lon, {S.q('y')} AS lat FROM tv""",
    *walk(3), S.cells_cte(3), "ring_cells AS (SELECT * FROM cells WHERE level=3 AND (patch, path) IN (SELECT (patch, path) FROM walk WHERE level=3))", *RINGS, recursive=True))
def _(fx):
    cells = G.with_cell(points(fx), P, 3).select("patch", "level", "path").distinct()
    ring = cover.scope_footprint(cells, 3)
    return ring.select("patch", "path", F.posexplode("ring").alias("ord", "v")).select(
        "patch", "path", "ord", quantize(C("v.lon")).alias("lon"), quantize(C("v.lat")).alias("lat"))


@query("cov_image_footprint", ora("images", f"""
SELECT image_id, CAST(i AS INTEGER) AS ord, {S.q("radians(gt0+((CASE i//8 WHEN 0 THEN lo+(hi-lo)*a WHEN 1 THEN hi WHEN 2 THEN hi+(lo-hi)*a ELSE lo END)+h)*gt1)")} AS lon,
 {S.q("radians(gt3+((CASE i//8 WHEN 0 THEN lo WHEN 1 THEN lo+(hi-lo)*a WHEN 2 THEN hi ELSE hi+(lo-hi)*a END)+h)*gt5)")} AS lat
FROM (SELECT *, CASE WHEN point_sampled THEN 0.0 ELSE -0.5 END AS lo, CASE WHEN point_sampled THEN 23.0 ELSE 23.5 END AS hi, CASE WHEN point_sampled THEN 0.0 ELSE 0.5 END AS h,
 (i%8)/8.0 AS a FROM images, (SELECT unnest(range(32)) AS i))"""))
def _(fx):
    ring = fx.images.withColumn("ring", coverage.image_ring(3))
    return ring.select("image_id", F.posexplode("ring").alias("ord", "v")).select(
        "image_id", "ord", quantize(C("v.lon")).alias("lon"), quantize(C("v.lat")).alias("lat"))


@query("src_default_coverage", ora("images", """
SELECT image_id, v.ord AS ord, CASE WHEN point_sampled THEN v.x*23 ELSE v.x*24-0.5 END AS x, CASE WHEN point_sampled THEN v.y*23 ELSE v.y*24-0.5 END AS y,
 floor((CASE WHEN point_sampled THEN v.x*23 ELSE v.x*23.2-0.1 END)*100+0.5)/100 AS ix, floor((CASE WHEN point_sampled THEN v.y*23 ELSE v.y*23.2-0.1 END)*100+0.5)/100 AS iy
FROM images, (VALUES (0,0.0,0.0),(1,1.0,0.0),(2,1.0,1.0),(3,0.0,1.0)) AS v(ord,x,y)"""))
def _(fx):
    r = lambda c: (F.floor(C(c) * 100 + 0.5) / 100).alias(c)
    return coverage.default_coverage(fx.images).select("image_id", "ord", "x", "y", r("ix"), r("iy"))


@query("src_coverage_vertices", ora("images polygons", """
SELECT image_id, ord, x, y FROM (SELECT poly_id AS image_id, ord, x, y FROM polygons WHERE poly_id%2=0) WHERE image_id IN (SELECT image_id FROM images)
UNION ALL SELECT image_id, v.ord, CASE WHEN point_sampled THEN v.x*23 ELSE v.x*24-0.5 END, CASE WHEN point_sampled THEN v.y*23 ELSE v.y*24-0.5 END
FROM images, (VALUES (0,0.0,0.0),(1,1.0,0.0),(2,1.0,1.0),(3,0.0,1.0)) AS v(ord,x,y) WHERE image_id NOT IN (SELECT poly_id FROM polygons WHERE poly_id%2=0)"""))
def _(fx):
    """Every second image comes with its own coverage polygon."""
    given = fx.polygons.where(C("poly_id") % 2 == 0).withColumnRenamed("poly_id", "image_id")
    return coverage.coverage_vertices(fx.images, given)


_CLOSED = "coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2"
_AT = lambda u, v: f"((x2-x)*({u}-x)+(y2-y)*({v}-y))"
_ODD = lambda px, py: f"sum(CASE WHEN (y<={py} AND y2>{py} AND ({px}-x)*(y2-y)<({py}-y)*(x2-x)) OR (y>{py} AND y2<={py} AND ({px}-x2)*(y-y2)<({py}-y2)*(x-x2)) THEN 1 ELSE 0 END)%2=1"
_LEVELS = 5


@query("cov_image_tile_join", ora("images", f"""
SELECT DISTINCT image_id, patch, CAST(level AS INTEGER) AS level, path FROM (
 SELECT image_id, patch, level, path FROM (SELECT c.image_id, c.patch, c.level, c.path, i.x, i.y, i.x2, i.y2, t.x+turn AS u, t.y AS v, t.x2+turn AS u2, t.y2 AS v2 FROM cand c JOIN ie i USING (image_id)
   JOIN te t ON t.patch=c.patch AND t.level=c.level AND t.path=c.path) WHERE ({{cross}})
 UNION ALL SELECT image_id, patch, level, path FROM cand c JOIN ie i USING (image_id) GROUP BY image_id, patch, level, path, turn, tx, ty HAVING {_ODD('(tx+turn)', 'ty')}
 UNION ALL SELECT c.image_id, c.patch, c.level, c.path FROM cand c JOIN (SELECT image_id, x AS ix, y AS iy FROM iv WHERE ord=0) USING (image_id) JOIN te t ON t.patch=c.patch AND t.level=c.level AND t.path=c.path
  GROUP BY c.image_id, c.patch, c.level, c.path, turn, ix, iy HAVING {_ODD('(ix-turn)', 'iy')})""".replace("{cross}", f"""
  CASE WHEN (x2-x)*(v-y)-(y2-y)*(u-x)=0 AND (x2-x)*(v2-y)-(y2-y)*(u2-x)=0 THEN greatest({_AT('u', 'v')},{_AT('u2', 'v2')})>=0 AND least({_AT('u', 'v')},{_AT('u2', 'v2')})<={_AT('x2', 'y2')}
  ELSE NOT (((x2-x)*(v-y)-(y2-y)*(u-x)<0 AND (x2-x)*(v2-y)-(y2-y)*(u2-x)<0) OR ((x2-x)*(v-y)-(y2-y)*(u-x)>0 AND (x2-x)*(v2-y)-(y2-y)*(u2-x)>0))
   AND {_AT('u2', 'v2')}+({_AT('u', 'v')}-{_AT('u2', 'v2')})*((x2-x)*(v2-y)-(y2-y)*(u2-x))/nullif(((x2-x)*(v2-y)-(y2-y)*(u2-x))-((x2-x)*(v-y)-(y2-y)*(u-x)),0) BETWEEN 0 AND {_AT('x2', 'y2')} END"""),
    S.BASE, S.cells_cte(_LEVELS),
    f"""want AS MATERIALIZED (SELECT image_id, CAST(min(lv) AS INTEGER) AS level FROM (SELECT image_id, {IMG_RES} AS res FROM (SELECT *, CASE WHEN point_sampled THEN 0.0 ELSE 0.5 END AS h FROM images)),
 (SELECT unnest(range(24)) AS lv) WHERE {RES0}*4/pow(2,lv)<=res*sqrt(2) GROUP BY image_id)""",
    "ring_cells AS (SELECT * FROM cells WHERE level IN (SELECT level FROM want))", *RINGS,
    f"te AS MATERIALIZED (SELECT patch, level, path, x, y, {_CLOSED} FROM tv WINDOW w AS (PARTITION BY patch, level, path ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
    "tb AS (SELECT patch, level, path, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, arg_min(x,ord) AS tx, arg_min(y,ord) AS ty FROM tv GROUP BY ALL)",
    """iv AS (SELECT image_id, i AS ord, radians(gt0+((CASE i//8 WHEN 0 THEN lo+(hi-lo)*a WHEN 1 THEN hi WHEN 2 THEN hi+(lo-hi)*a ELSE lo END)+h)*gt1) AS x,
  radians(gt3+((CASE i//8 WHEN 0 THEN lo WHEN 1 THEN lo+(hi-lo)*a WHEN 2 THEN hi ELSE hi+(lo-hi)*a END)+h)*gt5) AS y
 FROM (SELECT *, CASE WHEN point_sampled THEN 0.0 ELSE -0.5 END AS lo, CASE WHEN point_sampled THEN 23.0 ELSE 23.5 END AS hi, CASE WHEN point_sampled THEN 0.0 ELSE 0.5 END AS h, (i%8)/8.0 AS a FROM images, (SELECT unnest(range(32)) AS i)))""",
    f"ie AS (SELECT image_id, x, y, {_CLOSED} FROM iv WINDOW w AS (PARTITION BY image_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
    """cand AS MATERIALIZED (SELECT image_id, b.*, turn FROM (SELECT image_id, level, min(x) AS i0, max(x) AS i1, min(y) AS j0, max(y) AS j1 FROM iv JOIN want USING (image_id) GROUP BY ALL) i
 JOIN tb b ON b.level=i.level, (VALUES (0.0),(2*pi()),(-2*pi())) AS z(turn) WHERE x0+turn<=i1 AND x1+turn>=i0 AND y0<=j1 AND y1>=j0)""", recursive=True))
def _(fx):
    """Tiles of every image at the level its resolution asks for (17 samples per tile side)."""
    level = G.level_for(georef.Georef().finest_resolution(), n=17)
    return cover.image_tile_join(fx.images, level).select("image_id", "patch", "level", "path")


LINE_XYZ = f"""lxyz AS (SELECT line_id, ord, symbol_id, stamp, {S.sph('lon_deg', 'lat_deg', 'p', S.R + '+elev')} FROM line_points),
lseg AS (SELECT * FROM (SELECT line_id, ord AS seg, symbol_id, stamp, {S.cols('p')}, lead(px) OVER w AS qx, lead(py) OVER w AS qy, lead(pz) OVER w AS qz
 FROM lxyz WINDOW w AS (PARTITION BY line_id ORDER BY ord)) WHERE qx IS NOT NULL)"""

HAVE = "have AS (SELECT DISTINCT patch, level, path FROM walk)"


def coverage_ctes(levels: int):
    """lcov: cells of levels 0..levels that exist and that each segment crosses."""
    keep = f"seg, line_id, {S.cols('p', 'q')}"
    corners = S.cols(*S.CORNERS)
    split = S.split_from(f"(SELECT * FROM lcov WHERE level<{levels})")
    kids = f"""(SELECT * FROM (SELECT {keep}, s.patch, s.level+1 AS level, s.path+child*CAST(pow(4,s.level) AS BIGINT) AS path, {S.pick('child')} FROM {split} s
   JOIN (VALUES (0),(1),(2),(3)) AS k(child) ON true) t WHERE EXISTS (SELECT 1 FROM have h WHERE h.patch=t.patch AND h.level=t.level AND h.path=t.path))"""
    roots = f"(SELECT {keep}, patch, {corners} FROM lseg, base)"
    return (
        f"""lcov AS (SELECT {keep}, patch, 0 AS level, CAST(0 AS BIGINT) AS path, {corners} FROM {side_hits(roots)} WHERE {CROSSED}
 UNION ALL SELECT {keep}, patch, level, path, {corners} FROM {side_hits(kids)} WHERE {CROSSED})""",)


COV = (*walk(3), HAVE, LINE_XYZ, *coverage_ctes(3))


def line_segments(fx):
    return L.segments(L.positions(fx.line_points))


def existing(fx, level=3):
    leaf = G.with_cell(points(fx), P, level).select("patch", "level", "path").distinct()
    return G.ancestors(leaf).select("patch", "level", "path").distinct()


def bridge(fx):
    return cover.segment_cell_join(line_segments(fx), 3, existing(fx))


@query("cov_segment_cell_join", ora("geo_points line_points", """
SELECT line_id, seg, patch, CAST(level AS INTEGER) AS level, path, NOT EXISTS (SELECT 1 FROM have h WHERE h.patch=c.patch AND h.level=c.level+1 AND h.path%CAST(pow(4,c.level) AS BIGINT)=c.path) AS is_leaf FROM lcov c""",
    *COV, recursive=True))
def _(fx):
    return bridge(fx)


@query("cov_inherit", ora("geo_points line_points", "SELECT line_id, seg, patch, CAST(level AS INTEGER) AS level, path FROM lcov WHERE level=3", *COV, recursive=True))
def _(fx):
    """Level-3 coverage derived from that of level 2."""
    segs = line_segments(fx)
    tree = existing(fx)
    parents = cover.segment_cell_join(segs, 2, tree.where(C("level") <= 2)).where(C("level") == 2)
    return cover.inherit(parents, tree.where(C("level") == 3), segs, ["line_id", "seg"])


@query("cov_add_segments", ora("geo_points line_points", """
SELECT patch, CAST(level AS INTEGER) AS level, path, CAST(count(*) AS BIGINT) AS segments, bool_or(line_id%2=1) AS stale FROM lcov GROUP BY ALL""", *COV, recursive=True))
def _(fx):
    """Odd lines join a bridge that already holds the even ones and some of the new rows."""
    b = bridge(fx).drop("is_leaf")
    old, new = b.where(C("line_id") % 2 == 0), b.where((C("line_id") % 2 == 1) | (C("line_id") % 4 == 0))
    out, stale = cover.add_coverage(old, new, ["line_id", "seg"])
    n = out.groupBy("patch", "level", "path").agg(F.count(F.lit(1)).alias("segments"))
    return n.join(stale.withColumn("s", F.lit(True)), ["patch", "level", "path"], "left").select(
        "patch", "level", "path", "segments", F.coalesce("s", F.lit(False)).alias("stale"))


@query("cov_remove_segments", ora("geo_points line_points", """
SELECT patch, CAST(level AS INTEGER) AS level, path, CAST(count(*) FILTER (line_id%3<>0 OR seg<>1) AS BIGINT) AS segments, bool_or(line_id%3=0 AND seg=1) AS stale FROM lcov GROUP BY ALL""", *COV, recursive=True))
def _(fx):
    gone = line_segments(fx).where((C("line_id") % 3 == 0) & (C("seg") == 1))
    b = bridge(fx).drop("is_leaf")
    left, stale = cover.remove_coverage(b, gone, ["line_id", "seg"])
    keys = ["patch", "level", "path"]
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"))
    return n.join(stale.withColumn("s", F.lit(True)), keys, "full").select(
        *keys, F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("s", F.lit(False)).alias("stale"))


# tiles at mixed levels: every third point stores one at level point_id % 6, in layer point_id % 5
TILES = """tiles AS (SELECT point_id%5 AS layer_id, patch, level, path, min(elev) AS elev FROM walk JOIN pts USING (point_id)
 WHERE point_id%3=0 AND level=point_id%6 GROUP BY ALL)"""


def tiles(fx):
    df = G.with_cell(points(fx).where(C("point_id") % 3 == 0), P, (C("point_id") % 6).cast("int"))
    return df.groupBy((C("point_id") % 5).alias("layer_id"), "patch", "level", "path").agg(F.min("elev").alias("elev"))


def leaf_cells(fx):
    return G.with_cell(points(fx), P, 6).select("patch", "level", "path").distinct()


_ASOF = """up AS (SELECT DISTINCT patch, path, unnest(range(7)) AS l FROM walk WHERE level=6)"""


@query("cov_level_asof", ora("geo_points", """
SELECT u.patch, 6 AS level, u.path, CAST(max(t.level) AS INTEGER) AS found_level, arg_max(t.elev, t.level) AS elev FROM up u
JOIN (SELECT patch, level, path, min(elev) AS elev FROM tiles GROUP BY ALL) t ON t.patch=u.patch AND t.level=u.l AND t.path=u.path%CAST(pow(4,u.l) AS BIGINT) GROUP BY ALL""",
    *walk(6), TILES, _ASOF, recursive=True))
def _(fx):
    one = tiles(fx).groupBy("patch", "level", "path").agg(F.min("elev").alias("elev"))
    return Y.level_asof(leaf_cells(fx), one, [])


@query("cov_multi_layer_join", ora("geo_points", "SELECT patch, 6 AS level, path, " + ", ".join(
    f"coalesce(arg_max(t.elev, t.level) FILTER (t.layer_id={k}), -1.0) AS layer_{k}" for k in range(5)) + """ FROM up u
LEFT JOIN tiles t ON t.patch=u.patch AND t.level=u.l AND t.path=u.path%CAST(pow(4,u.l) AS BIGINT) GROUP BY ALL""".replace("patch, 6", "u.patch, 6"),
    *walk(6), TILES, _ASOF, recursive=True).replace("SELECT patch, 6 AS level, path,", "SELECT u.patch, 6 AS level, u.path,"))
def _(fx):
    return cover.multi_layer_join(leaf_cells(fx), tiles(fx), [0, 1, 2, 3, 4], "elev", -1.0)


@query("cov_cells_with_children", ora("geo_points", """
SELECT DISTINCT w.patch, CAST(w.level AS INTEGER) AS level, w.path FROM walk w JOIN tiles t ON t.patch=w.patch AND t.level=w.level+1 AND t.path%CAST(pow(4,w.level) AS BIGINT)=w.path""",
    *walk(5), TILES, recursive=True))
def _(fx):
    return cover.cells_with_children(existing(fx, 5), tiles(fx))
