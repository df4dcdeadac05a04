"""Fault displacement: planes of every line taken as a fault, and points moved along one fault."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.catalog.geo import sq, vq
from terrasphere.catalog.terrain import SURF, surface
from terrasphere.functions import sphere
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import fault as FL
from terrasphere.operators import sectors as SC
from terrasphere.operators import terrain as T
from terrasphere.session import cut_lineage

C = F.col
DIP = 60.0

# consecutive points never coincide: longitude grows a little with the order
LINES = f"fpt AS (SELECT line_id AS fault_id, ord, {S.sph('lon_deg+ord*0.01', 'lat_deg', 'v', S.R + '+elev')} FROM line_points)"
ONE = f"fpt AS (SELECT 1 AS fault_id, ord, {S.sph('lon_deg', 'lat_deg', 'v', S.R + '+elev')} FROM fault_points)"


def _rot(out: str, angle: float) -> str:
    a = f"radians({90 + angle})"
    return S.lin(out, (f"cos({a})", "h"), (f"sin({a})", "sh"), (f"(1-cos({a}))*{S.dot('s', 'h')}", "s"))


PLANES = (f"fpr AS (SELECT fault_id, ord, n, {', '.join(f'v{a}*r/{S.norm("v")} AS p{a}' for a in 'xyz')} FROM (SELECT *, avg({S.norm('v')}) OVER w AS r, count(*) OVER w AS n FROM fpt WINDOW w AS (PARTITION BY fault_id)))",
          f"""pln AS (SELECT *, {S.dot('p', 'g')} AS gs, {S.cross('s', 'f', 'fd')}, {S.cross('s', 'g', 'gd')} FROM (SELECT *, {_rot('f', 90.0)}, {_rot('g', DIP)} FROM (SELECT *, {S.cross('s', 'h', 'sh')} FROM (SELECT *, {S.unit('h0', 'h')} FROM (SELECT *, {S.cross('s', 'p', 'h0')} FROM (
 SELECT *, {S.unit('s0', 's')} FROM (SELECT *, {S.lin('s0', ('1', 'q'), ('-1', 'p'))} FROM (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy, lead(pz) OVER w AS qz FROM fpr WINDOW w AS (PARTITION BY fault_id ORDER BY ord)) WHERE qx IS NOT NULL)))))))""",
          f"""sep AS (SELECT fault_id, ord, {S.unit('m0', 'm')} FROM (SELECT fault_id, ord, {S.cross('w', 'c', 'm0')} FROM (
 SELECT p.fault_id, p.ord, {', '.join(f'coalesce(b.f{a},0)+coalesce(a.f{a},0) AS w{a}, p.p{a} AS c{a}' for a in 'xyz')} FROM fpr p
  LEFT JOIN pln a ON a.fault_id=p.fault_id AND a.ord=p.ord LEFT JOIN pln b ON b.fault_id=p.fault_id AND b.ord=p.ord-1 WHERE p.n>1)))""")


def line_faults(fx):
    p = put(fx.line_points.withColumn("lon_deg", C("lon_deg") + C("ord") * 0.01),
            **{"": sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("elev"))})
    return p.select(C("line_id").alias("fault_id"), "ord", "x", "y", "z")


def one_fault(fx):
    p = put(fx.fault_points, **{"": sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("elev"))})
    return p.select(F.lit(1).alias("fault_id"), "ord", "x", "y", "z")


@query("flt_planes", ora("line_points", f"SELECT fault_id, ord, {sq('s', 's', 1e5)}, {sq('f', 'f', 1e5)}, {sq('g', 'g', 1e5)}, {sq('d', 'gd', 1e5)}, {S.q('-gs', 1)} AS dist FROM pln", LINES, *PLANES))
def _(fx):
    pl = FL.planes(line_faults(fx), DIP)
    return pl.select("fault_id", "ord", *vq("s", V3.of("s"), 1e5), *vq("f", V3.of("f"), 1e5), *vq("g", V3.of("g"), 1e5), *vq("d", V3.of("gd"), 1e5),
                     quantize(C("g_dist"), 1).alias("dist"))


@query("flt_separating_planes", ora("line_points", f"SELECT fault_id, ord, {sq('m', 'm', 1e4)} FROM sep WHERE {S.norm('m')}>0", LINES, *PLANES))
def _(fx):
    return FL.separating_planes(FL.planes(line_faults(fx), DIP)).select("fault_id", "ord", *vq("m", V3.of("m"), 1e4))


@query("flt_center", ora("line_points", f"SELECT fault_id, {S.q('avg(px)', 10)} AS mx, {S.q('avg(py)', 10)} AS my_, {S.q('avg(pz)', 10)} AS mz FROM fpr GROUP BY fault_id", LINES, *PLANES))
def _(fx):
    m = V3.of("m")
    return FL.fault_center(line_faults(fx)).select("fault_id", quantize(m.x, 10).alias("mx"), quantize(m.y, 10).alias("my_"), quantize(m.z, 10).alias("mz"))


@query("flt_plane_distance", ora("line_points", f"""
SELECT fault_id, ord, {S.q(S.dot('q', 'g') + '+gs', 1)} AS dist, {S.q('gs*gx', 1)} AS center_x, {S.q('gs*gz', 1)} AS center_z FROM pln""", LINES, *PLANES))
def _(fx):
    pl = FL.planes(line_faults(fx), DIP)
    c = FL.plane_center(V3.of("g"), C("g_dist"))
    return pl.select("fault_id", "ord", quantize(FL.plane_distance(V3.of("q"), V3.of("g"), C("g_dist")), 1).alias("dist"),
                     quantize(c.x, 1).alias("center_x"), quantize(c.z, 1).alias("center_z"))


@query("flt_shift_vector", ora("line_points", f"SELECT fault_id, ord, {', '.join(S.q(f's{a}*1000+gd{a}*50', 10) + f' AS v{a}' for a in 'xyz')} FROM pln", LINES, *PLANES))
def _(fx):
    v = FL.shift_vector(V3.of("s"), V3.of("gd"), 1000.0, 50.0)
    return FL.planes(line_faults(fx), DIP).select("fault_id", "ord", *vq("v", v, 10))


@query("flt_linear_translation", ora("line_points", f"""
SELECT fault_id, {', '.join(S.q(f'CASE WHEN n>1 THEN 1000*l{a}/{S.norm("l")} ELSE 0 END', 100) + f' AS l{a}' for a in 'xyz')} FROM (
 SELECT fault_id, count(*) AS n, {', '.join(f'arg_max(v{a},ord)-arg_min(v{a},ord) AS l{a}' for a in 'xyz')} FROM fpt GROUP BY fault_id)""", LINES))
def _(fx):
    return FL.linear_translation(line_faults(fx), 1000.0).select("fault_id", *vq("l", V3.of("l"), 100))


@query("flt_segment_compression", ora("line_points", f"""
SELECT fault_id, ord AS segment, {S.q('c')} AS fourth_power, {S.q('CASE WHEN abs(c)>1e-6 THEN CASE WHEN c>0 THEN 1 ELSE -1 END*pow(abs(c),0.25) END', 1e3)} AS compression FROM (
 SELECT fault_id, ord, ({S.dot('h', 't')})/{S.norm('t')} AS c FROM (SELECT z.fault_id, z.ord, {', '.join(f'k.g{a} AS h{a}' for a in 'xyz')}, {', '.join(f'(z.q{a}-z.p{a})-z.p{a}*z.e AS t{a}' for a in 'xyz')}
  FROM (SELECT *, ({S.dot('q', 'p')}-{S.dot('p', 'p')})/{S.dot('p', 'p')} AS e FROM pln) z JOIN pln k ON k.fault_id=z.fault_id AND k.ord=1 WHERE z.ord>1))""", LINES, *PLANES))
def _(fx):
    """The fourth power of every segment, and the root where rounding does not decide it."""
    out = FL.segment_compression(FL.planes(line_faults(fx), DIP), 1.0)
    power = F.signum("compression") * F.pow("compression", F.lit(4))
    return out.select("fault_id", "segment", quantize(power).alias("fourth_power"), quantize(F.when(F.abs(power) > 1e-6, C("compression")), 1e3).alias("compression"))


@query("grid_effective_bounding_center", ora("line_points", f"""
SELECT fault_id, ord, {', '.join(S.q(f'v{a}+CASE WHEN n>1 THEN 1000*l{a}/{S.norm("l")} ELSE 0 END', 10) + f' AS b{a}_' for a in 'xyz')} FROM fpt JOIN (
 SELECT fault_id, count(*) AS n, {', '.join(f'arg_max(v{a},ord)-arg_min(v{a},ord) AS l{a}' for a in 'xyz')} FROM fpt GROUP BY fault_id) USING (fault_id)""", LINES))
def _(fx):
    """Bounding centres (here the control points themselves) moved by the linear translation."""
    p = line_faults(fx)
    b = V3.of("") + V3.of("l")
    return p.join(FL.linear_translation(p, 1000.0), "fault_id").select(
        "fault_id", "ord", *[quantize(c, 10).alias(f"b{a}_") for a, c in zip("xyz", (b.x, b.y, b.z))])


# points against the one fault, cut along its slope planes
PTS = f"fp AS (SELECT point_id, {S.sph('lon_deg', 'lat_deg*0.2', 'p', S.R)} FROM geo_points)"
SECT = f"""sct AS (SELECT f.point_id, g.ord-1 AS i, ({S.dot('f.p', 'g.g')})-g.gs AS d, {S.dot('f.p', 'a.m')} AS dl, {S.dot('f.p', 'b.m')} AS dr FROM fp f, pln g
 JOIN sep a ON a.ord=g.ord JOIN sep b ON b.ord=g.ord+1)"""
NEAR = "near AS (SELECT point_id, CAST(coalesce(arg_min(i,d) FILTER (d>0 AND d<1e9 AND (i=0 OR dl>0) AND (i=23 OR dr<0)),-1) AS INTEGER) AS k FROM sct GROUP BY point_id)"
FAULT = (ONE, *PLANES, PTS, SECT, NEAR)


def fault_points(fx):
    """(points, sectors of the one fault)"""
    pl = cut_lineage(FL.planes(one_fault(fx), DIP))  # read by the sectors and by their separating planes
    p = put(fx.geo_points, p=sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg") * 0.2, F.lit(0.0)))
    return p.select("point_id", F.lit(1).alias("fault_id"), "px", "py", "pz"), SC.sectors(pl, FL.separating_planes(pl))


@query("flt_nearest_plane", ora("geo_points fault_points", "SELECT point_id, k FROM near", *FAULT))
def _(fx):
    return SC.nearest_plane(*fault_points(fx), ["point_id"]).select("point_id", "k")


@query("flt_compression", ora("geo_points fault_points", f"""
SELECT point_id, {S.q('0.7*greatest(0,3000000-coalesce(min(d) FILTER (d>=0 AND dl>0 AND dr<0),1e9))/3000000')} AS factor FROM sct GROUP BY point_id""", *FAULT))
def _(fx):
    return SC.compression_factor(*fault_points(fx), ["point_id"], 3e6, 0.7).select("point_id", quantize(C("factor")).alias("factor"))


_STEP = f"""wlk AS (SELECT f.point_id, n.k, 900000.0::DOUBLE AS rest, 0.0::DOUBLE AS comp, {', '.join(f'f.p{a}' for a in 'xyz')}, 0 AS it FROM near n JOIN fp f USING (point_id) WHERE n.k>=0
 UNION ALL SELECT point_id, k+1, rest-w, comp+w*cf, {', '.join(f'p{a}+w*s{a}' for a in 'xyz')}, it+1 FROM (SELECT *, CASE WHEN lam>0 THEN least(lam,rest) ELSE 0 END AS w FROM (
  SELECT x.point_id, x.k, x.rest, x.comp, x.it, {', '.join(f'x.p{a}, g.s{a}' for a in 'xyz')}, -({S.dot('x.p', 'b.m')})/({S.dot('g.s', 'b.m')}) AS lam, -({S.dot('g.s', 'o.g')}) AS cf
  FROM wlk x JOIN pln g ON g.ord=x.k+1 JOIN sep b ON b.ord=x.k+2 JOIN pln o ON o.ord=1 WHERE x.rest>0 AND x.k<23)))"""


@query("flt_shift", ora("geo_points fault_points", f"""
SELECT point_id, {', '.join(S.q(f'p{a}', 1) + f' AS q{a}' for a in 'xyz')}, CAST(0 AS BIGINT) AS compression FROM fp JOIN near USING (point_id) WHERE k<0
UNION ALL SELECT x.point_id, {', '.join(S.q(f'x.p{a}+x.rest*g.s{a}+5000*g.gd{a}', 1) for a in 'xyz')}, {S.q(f'x.comp-x.rest*({S.dot("g.s", "o.g")})', 1)}
 FROM (SELECT * FROM wlk QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY it DESC)=1) x JOIN pln g ON g.ord=x.k+1 JOIN pln o ON o.ord=1""", *FAULT, _STEP, recursive=True))
def _(fx):
    p, sectors = fault_points(fx)
    out = SC.shift(SC.nearest_plane(p, sectors, ["point_id"]), sectors, ["point_id"], 900000.0, 5000.0)
    return out.select("point_id", *vq("q", V3.of("q"), 1), quantize(C("compression"), 1).alias("compression"))


_PN = (0.2, 0.3, 0.9, -1.0e6)
_TRI = "tri AS (" + " UNION ALL ".join(
    "SELECT patch, path, " + ", ".join(f"{u}{a} AS {o}{a}_" for u, o in zip(("a", *vs), "uvw") for a in "xyz") + " FROM quad" for vs in (("d", "c"), ("f", "d"))) + ")"
_D = {o: f"(0.2*{o}x_+0.3*{o}y_+0.9*{o}z_-1e6)" for o in "uvw"}
_AREA = """(0.5*sqrt(pow((vy_-uy_)*(wz_-uz_)-(vz_-uz_)*(wy_-uy_),2)+pow((vz_-uz_)*(wx_-ux_)-(vx_-ux_)*(wz_-uz_),2)+pow((vx_-ux_)*(wy_-uy_)-(vy_-uy_)*(wx_-ux_),2)))"""


def _one(a, b, c):
    return f"({a}/({a}-{b}))*({a}/({a}-{c}))"


@query("flt_split_triangles", ora("terrain", f"""
SELECT patch, path, side, {S.q('sum(area)/1e6', 1)} AS area, CAST(sum(n) AS BIGINT) AS triangles FROM (
 SELECT patch, path, 'stay' AS side, A*f AS area, CASE neg WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 1 END AS n FROM frac WHERE neg>0
 UNION ALL SELECT patch, path, 'move', A*(1-f), CASE neg WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END FROM frac WHERE neg<3) GROUP BY ALL""", *SURF[:-1], _TRI,
    f"""frac AS (SELECT patch, path, A, neg, CASE WHEN neg=0 THEN 0 WHEN neg=3 THEN 1 WHEN neg=1 THEN CASE WHEN du<0 THEN {_one('du', 'dv', 'dw')} WHEN dv<0 THEN {_one('dv', 'du', 'dw')} ELSE {_one('dw', 'du', 'dv')} END
  ELSE 1-CASE WHEN du>=0 THEN {_one('du', 'dv', 'dw')} WHEN dv>=0 THEN {_one('dv', 'du', 'dw')} ELSE {_one('dw', 'du', 'dv')} END END AS f FROM (
 SELECT patch, path, {_AREA} AS A, {', '.join(f'{_D[o]} AS d{o}' for o in 'uvw')}, (CASE WHEN du<0 THEN 1 ELSE 0 END)+(CASE WHEN dv<0 THEN 1 ELSE 0 END)+(CASE WHEN dw<0 THEN 1 ELSE 0 END) AS neg FROM tri))""", recursive=True))
def _(fx):
    """The terrain mesh cut by one plane: area and triangles on both sides of every tile."""
    tri = T.mesh(T.quads(surface(fx), 17))
    abc = tri.select("patch", "path", *[C(f"t{i}{a}").alias(v + a) for i, v in enumerate("abc") for a in "xyz"])
    cut = FL.split_triangles(abc, V3(*_PN[:3]), F.lit(_PN[3]))
    t0, t1, t2 = V3.of("t0"), V3.of("t1"), V3.of("t2")
    area = (t1 - t0).cross(t2 - t0).norm() * 0.5
    return cut.withColumn("area", area).groupBy("patch", "path", "side").agg(
        quantize(F.sum("area") / 1e6, 1).alias("area"), F.count(F.lit(1)).alias("triangles"))
