"""Map lines: ordered operators, edits, nearest searches and corridors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.coverage import COV, LINE_XYZ, bridge, line_segments
from terrasphere.catalog.geo import sq, vq
from terrasphere.functions import sphere
from terrasphere.functions.descent import with_scope
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import grid as G
from terrasphere.operators import lines as L
from terrasphere.operators import nearest as NR
from terrasphere.sources import vector_files as VF

C = F.col


def pts(fx):
    return L.positions(fx.line_points)


@query("vec_segments", ora("line_points", f"SELECT line_id, seg, {sq('a', 'p', 100)}, {sq('e', 'q', 100)} FROM lseg", LINE_XYZ))
def _(fx):
    return line_segments(fx).select("line_id", "seg", *vq("a", V3.of("a"), 100), *vq("e", V3.of("b"), 100))


@query("vec_cumulative_length", ora("line_points", f"""
SELECT line_id, ord, {S.q('sum(d) OVER (PARTITION BY line_id ORDER BY ord)', 10)} AS coord FROM (
 SELECT line_id, ord, coalesce(sqrt(pow(px-lag(px) OVER w,2)+pow(py-lag(py) OVER w,2)+pow(pz-lag(pz) OVER w,2)),0) AS d FROM (
  SELECT line_id, ord, {S.sph('lon_deg', 'lat_deg', 'p', S.R + '+elev*3')} FROM line_points) WINDOW w AS (PARTITION BY line_id ORDER BY ord))"""))
def _(fx):
    return L.cumulative_length(pts(fx), 3.0).select("line_id", "ord", quantize(C("coord"), 10).alias("coord"))


# edits of the log address positions 1..6 of their line; some refine instead of moving
EDITS = """ed AS (SELECT edit_id, line_id, CASE WHEN op='move' AND edit_id%3=0 THEN 'refine' ELSE op END AS op, edit_id%6+1 AS ord, lon_deg, lat_deg FROM line_edits)"""


def edits(fx):
    op = F.when((C("op") == "move") & (C("edit_id") % 3 == 0), "refine").otherwise(C("op"))
    return fx.line_edits.select("edit_id", "line_id", op.alias("op"), (C("edit_id") % 6 + 1).alias("ord"), "lon_deg", "lat_deg")


@query("vec_apply_edits", ora("line_points line_edits", """
SELECT line_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY g, pos, seq) AS BIGINT) AS ord, lon_deg, lat_deg FROM (
 SELECT p.line_id, 1 AS g, p.ord AS pos, -1 AS seq, coalesce(m.lon_deg,p.lon_deg) AS lon_deg, coalesce(m.lat_deg,p.lat_deg) AS lat_deg FROM line_points p
  LEFT JOIN (SELECT line_id, ord, arg_max(lon_deg,edit_id) AS lon_deg, arg_max(lat_deg,edit_id) AS lat_deg FROM ed WHERE op='move' GROUP BY ALL) m ON m.line_id=p.line_id AND m.ord=p.ord
  WHERE NOT EXISTS (SELECT 1 FROM ed e WHERE e.op='remove' AND e.line_id=p.line_id AND e.ord=p.ord)
 UNION ALL SELECT line_id, 1, ord, 1000000000-edit_id, lon_deg, lat_deg FROM ed WHERE op='refine'
 UNION ALL SELECT line_id, 0, -edit_id, 0, lon_deg, lat_deg FROM ed WHERE op='add_front'
 UNION ALL SELECT line_id, 2, edit_id, 0, lon_deg, lat_deg FROM ed WHERE op='add_back')""", EDITS))
def _(fx):
    return L.apply_edits(fx.line_points, edits(fx), ["lon_deg", "lat_deg"])


@query("vec_affected_segments", ora("line_points line_edits", """
SELECT DISTINCT e.line_id, s.seg FROM ed e JOIN (SELECT line_id, max(ord) AS n FROM line_points GROUP BY line_id) p ON p.line_id=e.line_id,
 LATERAL (SELECT unnest(CASE WHEN e.op IN ('move','remove') THEN [e.ord-1,e.ord] WHEN e.op='refine' THEN [e.ord] ELSE [] END) AS seg) s WHERE s.seg>=1 AND s.seg<p.n""", EDITS))
def _(fx):
    return L.affected_segments(fx.line_points, edits(fx))


@query("vec_adjacent_controls", ora("line_points", """
SELECT line_id, ord, CASE WHEN ord>1 THEN ord-1 END AS prev_segment, CASE WHEN ord<n THEN ord END AS next_segment,
 CASE WHEN ord<n THEN ord END AS segment_start, CASE WHEN ord<n THEN ord+1 END AS segment_end
FROM (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM line_points)"""))
def _(fx):
    return L.adjacent_controls(fx.line_points)


def attributes(fx):
    p = L.cumulative_length(pts(fx))
    segs = L.segments(p, ["symbol_id", "coord"])
    b = bridge(fx).where(C("level") == 3).drop("is_leaf")
    cells = with_scope(b.select("patch", "level", "path").distinct())
    cells = put(cells, m=G.centroid(6371000.0))
    return L.segment_attributes(b, segs, cells, fx.symbols)


_ATTR = f"""acells AS (SELECT *, {S.lin('m0', ('1', 'a'), ('1', 'f'), ('1', 'c'), ('1', 'd'))} FROM lcov WHERE level=3),
attr AS (SELECT c.line_id, c.seg, c.patch, c.path, s.symbol_id, y.symbol_name, {S.lin('r', ('1', 'c.p'), (f'-6371000/{S.norm("m0")}', 'm0'))}, {S.cross('c.p', 'c.q', 'n0')}
 FROM acells c JOIN lseg s ON s.line_id=c.line_id AND s.seg=c.seg LEFT JOIN symbols y ON y.symbol_id=s.symbol_id)"""


@query("vec_segment_attributes", ora("geo_points line_points symbols", f"""
SELECT patch, path, line_id, seg, symbol_name, {sq('r', 'r', 10)}, {sq('n', 'n', 1e4)} FROM (SELECT *, {S.unit('n0', 'n')} FROM attr)""", *COV, _ATTR, recursive=True))
def _(fx):
    return attributes(fx).select("patch", "path", "line_id", "seg", "symbol_name", *vq("r", V3.of("ra"), 10), *vq("n", V3.of("n"), 1e4))


@query("vec_stale_cells", ora("geo_points line_points", """
SELECT patch, CAST(level AS INTEGER) AS level, path FROM (
 SELECT c.patch, c.level, c.path, max(s.stamp) AS newest FROM lcov c JOIN lseg s ON s.line_id=c.line_id AND s.seg=c.seg GROUP BY ALL)
WHERE path%4=0 OR TIMESTAMP '1998-01-01 00:00:00'<=newest""", *COV, recursive=True))
def _(fx):
    """Line data of all cells but those of child 0 was made at the start of 1998."""
    segs = L.segments(pts(fx), ["stamp"])
    b = bridge(fx).drop("is_leaf").join(segs.select("line_id", "seg", "stamp"), ["line_id", "seg"])
    cells = b.select("patch", "level", "path").distinct().where(C("path") % 4 != 0)
    return L.stale_cells(b, cells.withColumn("data_stamp", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")))


@query("vec_set_symbol", ora("line_points", """
SELECT line_id, ord, CASE WHEN line_id%10=0 THEN 9 ELSE symbol_id END AS symbol_id,
 CASE WHEN line_id%10=0 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE stamp END AS stamp FROM line_points"""))
def _(fx):
    changes = fx.line_points.select("line_id").distinct().where(C("line_id") % 10 == 0).withColumn("new_symbol", F.lit(9))
    now = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return L.set_symbol(fx.line_points, changes, now).select("line_id", "ord", "symbol_id", "stamp")


# surface samples: points moved next to lines by reading them modulo the line area
SMP = f"""smp AS (SELECT g.point_id, p.line_id AS near_line, {S.sph("p.lon_deg+(g.point_id%7-3)/50.0", "p.lat_deg+(g.point_id%5-2)/50.0", 's', S.R)}
 FROM geo_points g JOIN line_points p ON p.line_id=g.user_id AND p.ord=g.point_id%10+1)"""


def samples(fx):
    p = fx.line_points.select(C("line_id").alias("user_id"), (C("ord") - 1).alias("_o"), C("lon_deg").alias("lo"), C("lat_deg").alias("la"))
    g = fx.geo_points.select("point_id", "user_id", (C("point_id") % 10).alias("_o"))
    lon, lat = C("lo") + (C("point_id") % 7 - 3) / 50.0, C("la") + (C("point_id") % 5 - 2) / 50.0
    return put(g.join(p, ["user_id", "_o"]), q=sphere.geodetic_to_cart(lon, lat, F.lit(0.0))).select("point_id", C("user_id").alias("line_id"), "qx", "qy", "qz")


def queries_(fx):
    return samples(fx).drop("line_id")


@query("vec_nearest_control_point", ora("line_points geo_points", f"""
SELECT point_id, {S.q('min(d)', 10)} AS dist, CAST(count(*) AS BIGINT) AS candidates FROM (
 SELECT s.point_id, sqrt(pow(s.sx-p.px,2)+pow(s.sy-p.py,2)+pow(s.sz-p.pz,2)) AS d FROM smp s, lxyz p WHERE abs(s.sx-p.px)<=20000 AND abs(s.sy-p.py)<=20000 AND abs(s.sz-p.pz)<=20000)
WHERE d<=20000 GROUP BY point_id""", LINE_XYZ, SMP))
def _(fx):
    q = queries_(fx)
    best = NR.nearest_control_point(q, pts(fx), ["point_id"], 20000.0)
    n = NR.point_candidates(q, pts(fx), 20000.0).groupBy("point_id").agg(F.count(F.lit(1)).alias("candidates"))
    return best.join(n, "point_id").select("point_id", quantize(C("dist"), 10).alias("dist"), "candidates")


@query("vec_nearest_control_point_anywhere", ora("line_points geo_points", f"""
SELECT point_id, {S.q('min(sqrt(pow(g.gx-p.px,2)+pow(g.gy-p.py,2)+pow(g.gz-p.pz,2)))', 10)} AS dist
FROM (SELECT point_id, {S.sph('lon_deg', 'lat_deg', 'g', S.R + '+elev')} FROM geo_points) g, lxyz p GROUP BY point_id""", LINE_XYZ))
def _(fx):
    """Every point of the globe and the control point nearest to it, however far away."""
    q = put(fx.geo_points, q=sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("elev")))
    return NR.nearest_control_point(q, pts(fx), ["point_id"]).select("point_id", quantize(C("dist"), 10).alias("dist"))


SEGD = f"""segd AS (SELECT * FROM (SELECT point_id, line_id, seg, {S.dot('n', 's')} AS sd, abs(sd) AS d, u FROM (
 SELECT s.point_id, g.line_id, g.seg, {S.cols('s', 'p', 'q')}, {S.lin('e', ('1', 'q'), ('-1', 'p'))}, {S.cross('p', 'e', 'n0')},
  (({S.dot('s', 'e')})-({S.dot('p', 'e')}))/{S.dot('e', 'e')} AS u, {', '.join(f'n0{a}/({S.norm("p")}*{S.norm("e")}) AS n{a}' for a in 'xyz')}
 FROM smp s, lseg g WHERE abs(s.sx-(g.px+g.qx)/2)<=900000 AND abs(s.sy-(g.py+g.qy)/2)<=900000 AND abs(s.sz-(g.pz+g.qz)/2)<=900000)) WHERE u>=0 AND u<=1 AND d<=20000)"""


@query("vec_nearest_segment", ora("line_points geo_points", f"SELECT point_id, {S.q('min(d)', 1)} AS dist FROM segd GROUP BY point_id", LINE_XYZ, SMP, SEGD))
def _(fx):
    return NR.nearest_segment(queries_(fx), line_segments(fx), ["point_id"], 20000.0).select("point_id", quantize(C("dist"), 1).alias("dist"))


@query("vec_nearest_end", ora("line_points geo_points", f"""
SELECT point_id, CASE WHEN fd<bd THEN 'front' ELSE 'back' END AS "end", CASE WHEN fd<bd THEN 1 ELSE n END AS ord, {S.q('least(fd,bd)', 10)} AS dist FROM (
 SELECT s.point_id, sqrt(pow(s.sx-f.px,2)+pow(s.sy-f.py,2)+pow(s.sz-f.pz,2)) AS fd, sqrt(pow(s.sx-b.px,2)+pow(s.sy-b.py,2)+pow(s.sz-b.pz,2)) AS bd, b.ord AS n
 FROM smp s JOIN lxyz f ON f.line_id=s.near_line AND f.ord=1 JOIN (SELECT * FROM lxyz QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY ord DESC)=1) b ON b.line_id=s.near_line)""", LINE_XYZ, SMP))
def _(fx):
    return NR.nearest_end(samples(fx), pts(fx), ["point_id"]).select("point_id", "end", "ord", quantize(C("dist"), 10).alias("dist"))


@query("vec_select", ora("line_points geo_points", f"""
, pl AS (SELECT s.point_id, p.line_id, min(sqrt(pow(s.sx-p.px,2)+pow(s.sy-p.py,2)+pow(s.sz-p.pz,2))) AS pd FROM smp s, lxyz p WHERE abs(s.sx-p.px)<=40000 AND abs(s.sy-p.py)<=40000 AND abs(s.sz-p.pz)<=40000 GROUP BY ALL),
 sl AS (SELECT point_id, line_id, min(d) AS sd FROM segd GROUP BY ALL),
 c AS (SELECT point_id, line_id, CASE WHEN coalesce(pd*0.5,1e30)<=coalesce(sd,1e30) THEN pd ELSE sd END AS d, CASE WHEN coalesce(pd*0.5,1e30)<=coalesce(sd,1e30) THEN 'point' ELSE 'segment' END AS kind FROM pl FULL JOIN sl USING (point_id, line_id))
SELECT point_id, {S.q('min(d)', 1)} AS dist, arg_min(kind, d) AS kind FROM c WHERE d<=15000 GROUP BY point_id""".replace("\n, pl AS", "SELECT * FROM (WITH pl AS", 1) + ")", LINE_XYZ, SMP, SEGD))
def _(fx):
    """Within 15 km; points are favoured by a factor of two."""
    return NR.select(queries_(fx), pts(fx), line_segments(fx), ["point_id"], 0.5, 15000.0).select(
        "point_id", quantize(C("dist"), 1).alias("dist"), "kind")


def uv(fx):
    cell = G.with_cell(put(samples(fx), p=V3.of("q"), s=V3.of("q").unit()), V3.of("q"), 3)
    p = L.cumulative_length(pts(fx))
    end = L.with_neighbors(p, "line_id", lead={"coord": "b_coord", "x": "bx", "y": "by", "z": "bz"}).where(C("bx").isNotNull())
    segs = end.select("line_id", C("ord").alias("seg"), C("x").alias("ax"), C("y").alias("ay"), C("z").alias("az"), "bx", "by", "bz",
                      C("coord").alias("a_coord"), "b_coord")
    cov = bridge(fx).where(C("level") == 3).drop("is_leaf").join(segs, ["line_id", "seg"])
    return L.line_uv(cell.drop("line_id", "qx", "qy", "qz"), cov, 15000.0, 1.0, F.lit(50000.0))


_UV = (f"""sn AS (SELECT point_id, {S.cols('s')}, {S.unit('s', 'k')} FROM smp)""", S.patch_cte("sn", "point_id", "k", "snp"),
       S.descent_cte("snp", "point_id", "k", 3, "swalk"),
       f"""crd AS (SELECT line_id, ord, sum(d) OVER (PARTITION BY line_id ORDER BY ord) AS coord FROM (SELECT line_id, ord,
 coalesce(sqrt(pow(px-lag(px) OVER w,2)+pow(py-lag(py) OVER w,2)+pow(pz-lag(pz) OVER w,2)),0) AS d FROM lxyz WINDOW w AS (PARTITION BY line_id ORDER BY ord))),
uvs AS (SELECT point_id, line_id, seg, v, ac+(bc-ac)*al AS run FROM (SELECT *, {S.dot('t', 'e')}/{S.dot('e', 'e')} AS al, ({S.dot('s', 'w')}-{S.dot('p', 'w')})/{S.dot('e', 'w')} AS g FROM (
 SELECT *, {S.dot('t', 'n')}/sqrt(1-pow({S.dot('n', 'k')},2))/15000 AS v, {S.cross('n', 's', 'w')} FROM (
 SELECT *, {S.unit('n0', 'n')}, {S.lin('t', ('1', 's'), ('-1', 'p'))}, {S.lin('e', ('1', 'q'), ('-1', 'p'))} FROM (
 SELECT w.point_id, c.line_id, c.seg, sn.sx, sn.sy, sn.sz, w.kx, w.ky, w.kz, c.px, c.py, c.pz, c.qx, c.qy, c.qz, a.coord AS ac, b.coord AS bc, {S.cross('c.p', 'c.q', 'n0')}
 FROM (SELECT * FROM swalk WHERE level=3) w JOIN sn USING (point_id) JOIN lcov c ON c.level=3 AND c.patch=w.patch AND c.path=w.path
  JOIN crd a ON a.line_id=c.line_id AND a.ord=c.seg JOIN crd b ON b.line_id=c.line_id AND b.ord=c.seg+1)))) WHERE abs(v)<=1 AND g>=0 AND g<=1)""")


@query("vec_line_uv", ora("geo_points line_points", f"""
SELECT point_id, line_id, seg, {S.q('v', 1e4)} AS v, {S.q('run/50000-floor(run/50000)', 1e3)} AS u FROM uvs""", *COV, SMP, *_UV, recursive=True))
def _(fx):
    return uv(fx).select("point_id", "line_id", "seg", quantize(C("v"), 1e4).alias("v"), quantize(C("u"), 1e3).alias("u"))


@query("vec_line_corridor", ora("geo_points line_points", f"""
SELECT point_id, CAST(count(*) AS BIGINT) AS covers, CASE WHEN count(*)>1 THEN 'multiple' ELSE 'single' END AS coverage, {S.q('min(abs(v))', 1e4)} AS nearest
FROM uvs GROUP BY point_id""", *COV, SMP, *_UV, recursive=True))
def _(fx):
    return L.line_corridor(uv(fx), "point_id").select("point_id", "covers", "coverage", quantize(F.abs("v"), 1e4).alias("nearest"))


@query("vec_allocate_ids", ora("line_points", """
, used AS (SELECT DISTINCT line_id AS id FROM line_points), fresh AS (SELECT DISTINCT line_id+1000000 AS k FROM line_points),
 fr AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT unnest(range(1,(SELECT max(id) FROM used)+1)) AS id) WHERE id NOT IN (SELECT id FROM used)),
 nw AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM fresh)
SELECT k, CAST(coalesce(fr.id, (SELECT max(id) FROM used)+nw.r-(SELECT count(*) FROM fr)) AS BIGINT) AS id FROM nw LEFT JOIN fr USING (r)""".replace("\n, used AS", "SELECT * FROM (WITH used AS", 1) + ")"))
def _(fx):
    """As many new lines as there are: the gaps between ids are used up first."""
    used = fx.line_points.select(C("line_id").alias("id")).distinct()
    return L.allocate_ids(used.select((C("id") + 1000000).alias("k")), "k", used)


@query("vec_write_lines", ora("line_points", f"""
SELECT line_id, CAST(count(*) AS BIGINT) AS points, CAST(CASE WHEN line_id%6 BETWEEN 1 AND 4 THEN line_id%6 ELSE 0 END AS INTEGER) AS symbol_id,
 {S.q('sum(lon_deg)', 1e3)} AS lon_sum, {S.q('sum(elev)', 10)} AS elev_sum FROM line_points GROUP BY line_id"""))
def _(fx):
    """Written as GeoJSON and read back; symbols 0 and 5 are unknown and become the default."""
    features = VF.write_lines(pts(fx).withColumn("symbol_id", (C("line_id") % 6).cast("int")), part_rows=8)
    back = VF.read_features(features, fx.symbols)
    return back.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("points"), F.max("symbol_id").alias("symbol_id"), quantize(F.sum("lon_deg"), 1e3).alias("lon_sum"),
        quantize(F.sum("elev"), 10).alias("elev_sum"))


@query("vec_read_lines", ora("line_points", f"""
SELECT line_id, CAST((ord-1)//8 AS BIGINT) AS part, CAST((ord-1)%8 AS INTEGER) AS pos, {S.q('lon_deg', 1e4)} AS lon, {S.q('lat_deg', 1e4)} AS lat FROM line_points"""))
def _(fx):
    back = VF.read_features(VF.write_lines(pts(fx), part_rows=8), fx.symbols)
    return back.select("line_id", "part", "pos", quantize(C("lon_deg"), 1e4).alias("lon"), quantize(C("lat_deg"), 1e4).alias("lat"))


@query("vec_delete_lines", ora("geo_points line_points", """
SELECT line_id, CAST(count(*) AS BIGINT) AS points, CAST(any_value(n) AS BIGINT) AS bridge_rows FROM (
 SELECT p.line_id, coalesce(b.n,0) AS n FROM line_points p LEFT JOIN (SELECT line_id, count(*) AS n FROM lcov GROUP BY line_id) b ON b.line_id=p.line_id WHERE p.line_id%4<>1) GROUP BY line_id""", *COV, recursive=True))
def _(fx):
    gone = fx.line_points.select("line_id").where(C("line_id") % 4 == 1)
    p, b = VF.delete_lines(fx.line_points, bridge(fx), gone)
    n = b.groupBy("line_id").agg(F.count(F.lit(1)).alias("bridge_rows"))
    return p.groupBy("line_id").agg(F.count(F.lit(1)).alias("points")).join(n, "line_id", "left").fillna(0, ["bridge_rows"])


@query("vec_delete_all", ora("line_points", "SELECT CAST(count(*) FILTER (false) AS BIGINT) AS points, CAST(count(*) AS BIGINT) AS before FROM line_points"))
def _(fx):
    p, _ = VF.delete_all(fx.line_points, fx.line_points)
    left = p.agg(F.count(F.lit(1)).alias("points"))
    return left.crossJoin(fx.line_points.agg(F.count(F.lit(1)).alias("before")))  # one row each
