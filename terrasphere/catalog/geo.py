"""Scalar geometry over points, point pairs and image rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS as R
from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ora, query
from terrasphere.functions import georef, hits, sphere
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators.lines import unwrap_rings

C = F.col


def vq(prefix: str, v: V3, scale: float = 1e6):
    return [quantize(c, scale).alias(prefix + a) for a, c in zip("xyz", (v.x, v.y, v.z))]


def sq(prefix: str, v: str, scale: float = 1e6) -> str:
    return ", ".join(f"{S.q(v + a, scale)} AS {prefix}{a}" for a in "xyz")


def pairs(fx):
    """Point pairs with unit vectors p and q."""
    return put(
        fx.point_pairs,
        p=sphere.sph_to_cart(F.radians("lon_deg"), F.radians("lat_deg")),
        q=sphere.sph_to_cart(F.radians("lon2_deg"), F.radians("lat2_deg")),
    )


PAIRS = f"pq AS (SELECT *, {S.sph('lon_deg', 'lat_deg', 'p')}, {S.sph('lon2_deg', 'lat2_deg', 'q')} FROM point_pairs)"
P, Q = V3.of("p"), V3.of("q")


@query("geo_cart_to_sph", ora("point_pairs", f"""
SELECT point_id, {S.q('atan2(py,px)')} AS lon, {S.q('asin(greatest(-1,least(1,pz)))')} AS lat FROM pq""", PAIRS))
def _(fx):
    lon, lat = sphere.cart_to_sph(P * 3.0)
    return pairs(fx).select("point_id", quantize(lon).alias("lon"), quantize(lat).alias("lat"))


@query("geo_sph_to_cart", ora("geo_points", f"""
SELECT point_id, {sq('o', 'v')} FROM (SELECT point_id, {S.sph('lon_deg', 'lat_deg', 'v')} FROM geo_points)"""))
def _(fx):
    return fx.geo_points.select(
        "point_id", *vq("o", sphere.sph_to_cart(F.radians("lon_deg"), F.radians("lat_deg"))))


@query("geo_haversine", ora("point_pairs", f"""
SELECT point_id, {S.q(S.hav('radians(lon_deg)', 'radians(lat_deg)', 'radians(lon2_deg)', 'radians(lat2_deg)'), 10)} AS metres
FROM point_pairs"""))
def _(fx):
    d = sphere.haversine(*sphere.to_radians(C("lon_deg"), C("lat_deg"), C("lon2_deg"), C("lat2_deg")))
    return fx.point_pairs.select("point_id", quantize(d, 10).alias("metres"))


@query("geo_radians_degrees", ora("geo_points", f"""
SELECT point_id, {S.q('lon_deg*pi()/180')} AS lon, {S.q('lat_deg*pi()/180')} AS lat,
 {S.q('lon_deg')} AS lon_back, {S.q('(lat_deg*pi()/180)*180/pi()')} AS lat_back FROM geo_points"""))
def _(fx):
    lon, lat = sphere.to_radians(C("lon_deg"), C("lat_deg"))
    lon_b, lat_b = sphere.to_degrees(lon, lat)
    return fx.geo_points.select(
        "point_id", quantize(lon).alias("lon"), quantize(lat).alias("lat"),
        quantize(lon_b).alias("lon_back"), quantize(lat_b).alias("lat_back"))


@query("geo_geodetic_cart", ora("geo_points", f"""
SELECT point_id, {sq('o', 'v', 100)}, {S.q('degrees(atan2(vy,vx))')} AS lon, {S.q('degrees(asin(vz/' + S.norm('v') + '))')} AS lat,
 {S.q(S.norm('v') + '-' + S.R, 100)} AS elev_out
FROM (SELECT point_id, {S.sph('lon_deg', 'lat_deg', 'v', S.R + '+elev')} FROM geo_points)"""))
def _(fx):
    v = V3.of("v")
    lon, lat, elev = sphere.cart_to_geodetic(v)
    return put(fx.geo_points, v=sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("elev"))).select(
        "point_id", *vq("o", v, 100), quantize(lon).alias("lon"), quantize(lat).alias("lat"),
        quantize(elev, 100).alias("elev_out"))


@query("geo_vertical_scale", ora("geo_points", f"""
SELECT point_id, {S.q('elev*5', 100)} AS scaled_elev, {S.q('elev/5', 100)} AS unscaled_elev, {S.q('elev', 100)} AS round_trip
FROM geo_points"""))
def _(fx):
    v, s, u, b = V3.of("v"), V3.of("s"), V3.of("u"), V3.of("b")
    df = put(fx.geo_points, v=sphere.geodetic_to_cart(C("lon_deg"), C("lat_deg"), C("elev")))
    df = put(df, s=sphere.to_scaled(v, 5.0), u=sphere.to_unscaled(v, 5.0))
    df = put(df, b=sphere.to_unscaled(s, 5.0))
    return df.select("point_id", quantize(s.norm() - R, 100).alias("scaled_elev"),
                     quantize(u.norm() - R, 100).alias("unscaled_elev"), quantize(b.norm() - R, 100).alias("round_trip"))


# image georeferencing: every pixel against its image row
PIX = "pi AS (SELECT p.*, i.* EXCLUDE (image_id) FROM pixels p JOIN images i USING (image_id))"


def pix(fx):
    return fx.pixels.join(fx.images, "image_id")


_H = "(CASE WHEN point_sampled THEN 0.0 ELSE 0.5 END)"


def _snap(c: str, size: str) -> str:
    return (f"CASE WHEN point_sampled THEN {c} WHEN {c}-0.5<0 AND {c}-0.5>=-0.5 THEN 0.0 "
            f"WHEN {c}-0.5>{size}-1 AND {c}-0.5<={size}-0.5 THEN {size}-1.0 ELSE {c}-0.5 END")


@query("geo_affine", ora("pixels images", f"""
SELECT image_id, px, py, {S.q('gt0+px*gt1')} AS u, {S.q('gt3+py*gt5')} AS v, {S.q('px')} AS back_x, {S.q('py')} AS back_y FROM pi""", PIX))
def _(fx):
    g = georef.Georef()
    u, v = g.affine_fwd(C("px"), C("py"))
    x, y = g.affine_inv(u, v)
    return pix(fx).select("image_id", "px", "py", quantize(u).alias("u"), quantize(v).alias("v"),
                          quantize(x).alias("back_x"), quantize(y).alias("back_y"))


@query("geo_image_system", ora("pixels images", f"""
SELECT image_id, px, py, {S.q(f'gt0+(px+{_H})*gt1')} AS u, {S.q(f'gt3+(py+{_H})*gt5')} AS v,
 {S.q(_snap('(px*1.07-0.3)', 'size_x'))} AS snap_x, {S.q(_snap('(py*1.07-0.3)', 'size_y'))} AS snap_y FROM pi""", PIX))
def _(fx):
    g = georef.Georef()
    u, v = g.image_to_system(C("px"), C("py"))
    # positions slightly beyond the borders, so that snapping applies to some
    x, y = g.system_to_image(*g.affine_fwd(C("px") * 1.07 - 0.3, C("py") * 1.07 - 0.3))
    return pix(fx).select("image_id", "px", "py", quantize(u).alias("u"), quantize(v).alias("v"),
                          quantize(x).alias("snap_x"), quantize(y).alias("snap_y"))


@query("geo_scale_offset", ora("pixels images", f"""
SELECT image_id, px, py, {S.q('px*gt1+gt0')} AS u, {S.q('py*gt5+gt3')} AS v, {S.q('px')} AS x, {S.q('py')} AS y,
 {S.q('px*gt1+gt0')} AS u0, {S.q('(py+2)*gt5+gt3')} AS v0, {S.q('(px+2)*gt1+gt0')} AS u1, {S.q('py*gt5+gt3')} AS v1 FROM pi""", PIX))
def _(fx):
    so = (C("gt1"), C("gt5"), C("gt0"), C("gt3"))
    u, v = georef.scale_offset_fwd(C("px"), C("py"), *so)
    x, y = georef.scale_offset_inv(u, v, *so)
    box = georef.scale_offset_box(C("px"), C("py"), C("px") + 2, C("py") + 2, *so)
    return pix(fx).select(
        "image_id", "px", "py", quantize(u).alias("u"), quantize(v).alias("v"), quantize(x).alias("x"),
        quantize(y).alias("y"), *[quantize(c).alias(n) for c, n in zip(box, ("u0", "v0", "u1", "v1"))])


@query("geo_flip_y", ora("pixels images", f"""
SELECT image_id, px, py, {S.q('gt3+23*gt5')} AS flip_gt3, {S.q('-gt5')} AS flip_gt5, {S.q('gt3+(23-py)*gt5')} AS v_flipped,
 {S.q('23-py')} AS cov_y FROM pi""", PIX))
def _(fx):
    g = georef.Georef()
    flip = g.flip_y()
    off, sc = georef.scale_offset_flip(C("gt3"), C("gt5"), C("size_y"))
    return pix(fx).select(
        "image_id", "px", "py", quantize(flip["gt3"]).alias("flip_gt3"), quantize(flip["gt5"]).alias("flip_gt5"),
        quantize(off + C("py") * sc).alias("v_flipped"), quantize(georef.flip_coverage_y(C("py"), C("size_y"))).alias("cov_y"))


@query("geo_box_transform", ora("images", f"""
SELECT image_id, {S.q(f'gt0+(3+{_H})*gt1')} AS u0, {S.q(f'gt3+(20+{_H})*gt5')} AS v0, {S.q(f'gt0+(17+{_H})*gt1')} AS u1,
 {S.q(f'gt3+(5+{_H})*gt5')} AS v1 FROM images"""))
def _(fx):
    box = georef.Georef().box_to_system(3, 5, 17, 20)
    return fx.images.select("image_id", *[quantize(c).alias(n) for c, n in zip(box, ("u0", "v0", "u1", "v1"))])


_lon = f"radians(gt0+(12+{_H})*gt1)"
_lat = f"radians(gt3+(12+{_H})*gt5)"
_glat = "(CASE WHEN abs(radians(gt3))>abs(radians(gt3+23*gt5)) THEN radians(gt3) ELSE radians(gt3+23*gt5) END)"


@query("geo_finest_resolution", ora("images", f"""
SELECT image_id, {S.q('least(' + S.hav(_lon, _lat, _lon + '+radians(gt1)', _lat) + ',' + S.hav(_lon, _lat, _lon, _lat + '+radians(gt5)') + ')', 10)} AS projected,
 {S.q('least(' + S.hav('0', _glat, 'radians(gt1)', _glat) + ',' + S.hav('0', _glat, '0', _glat + '+radians(gt5)') + ')', 10)} AS geographic
FROM images"""))
def _(fx):
    g = georef.Georef()
    return fx.images.select("image_id", quantize(g.finest_resolution(), 10).alias("projected"),
                            quantize(g.finest_resolution_geographic(), 10).alias("geographic"))


@query("geo_system_compatible", ora("images", """
SELECT grid_x, grid_y, CAST(count(*) AS BIGINT) AS images, CAST(min(image_id) AS BIGINT) AS first_image FROM (
 SELECT image_id, CAST(floor(((gt0/gt1)-floor(gt0/gt1))*1000+0.5) AS INTEGER)%1000 AS grid_x,
  CAST(floor(((gt3/gt5)-floor(gt3/gt5))*1000+0.5) AS INTEGER)%1000 AS grid_y FROM images) GROUP BY ALL"""))
def _(fx):
    """Classes of mutually compatible grids: pairs are implied, never emitted."""
    return (
        fx.images.select("image_id", georef.grid_phase(C("gt0"), C("gt1")).alias("grid_x"),
                         georef.grid_phase(C("gt3"), C("gt5")).alias("grid_y"))
        .groupBy("grid_x", "grid_y").agg(F.count(F.lit(1)).alias("images"), F.min("image_id").alias("first_image")))


@query("geo_system_compatible_with_first", ora("images", """
SELECT image_id, abs((gt0-g0)/gt1-floor((gt0-g0)/gt1+0.5))<0.001 AND abs((gt3-g3)/gt5-floor((gt3-g3)/gt5+0.5))<0.001 AS ok
FROM images, (SELECT gt0+0.25 AS g0, gt3 AS g3 FROM images QUALIFY row_number() OVER (ORDER BY image_id)=1)"""))
def _(fx):
    first = F.min_by(F.struct((C("gt0") + 0.25).alias("g0"), C("gt3").alias("g3")), "image_id")
    head = fx.images.agg(first.alias("h")).select("h.*")
    ok = georef.system_compatible(C("gt1"), C("gt5"), C("g0"), C("g3"), C("gt1"), C("gt5"), C("gt0"), C("gt3"))
    return fx.images.join(F.broadcast(head)).select("image_id", ok.alias("ok"))  # head is one row


@query("geo_unwrap_lonlat", ora("polygons", f"""
, r AS (SELECT poly_id, ord, radians(x*1.05) AS lon, radians(y) AS lat, lag(radians(x*1.05)) OVER w AS plon FROM polygons WINDOW w AS (PARTITION BY poly_id ORDER BY ord)),
s AS (SELECT *, CASE WHEN plon IS NULL THEN 0 WHEN lon-plon>pi() THEN -1 WHEN lon-plon<-pi() THEN 1 ELSE 0 END AS turn FROM (
 SELECT poly_id, ord, lat, (CASE WHEN lon>pi() THEN lon-2*pi() ELSE lon END) AS lon,
  lag(CASE WHEN lon>pi() THEN lon-2*pi() ELSE lon END) OVER (PARTITION BY poly_id ORDER BY ord) AS plon FROM r))
SELECT poly_id, ord, {S.q('lon+2*pi()*sum(turn) OVER (PARTITION BY poly_id ORDER BY ord)')} AS lon, {S.q('lat')} AS lat FROM s""".replace("\n, r AS", "\nSELECT * FROM (WITH r AS", 1) + ")"))
def _(fx):
    """Rings stretched across the antimeridian, wrapped to (-pi, pi] and unwrapped again."""
    lon = F.radians(C("x") * 1.05)
    wrapped = F.when(lon > sphere.HALF_PI * 2, lon - sphere.TWO_PI).otherwise(lon)
    ring = fx.polygons.select("poly_id", (C("ord") + 1).cast("bigint").alias("ord"), wrapped.alias("lon"), F.radians("y").alias("lat"))
    return unwrap_rings(ring, "poly_id").select(
        "poly_id", (C("ord") - 1).cast("int").alias("ord"), quantize(C("lon")).alias("lon"), quantize(C("lat")).alias("lat"))


@query("geo_slerp", ora("point_pairs", f"""
SELECT point_id, {sq('o', 'w')} FROM (
 SELECT point_id, acos(greatest(-1,least(1,{S.dot('p', 'q')}))) AS om,
  {S.lin('w', ('sin(0.75*om)/sin(om)', 'p'), ('sin(0.25*om)/sin(om)', 'q'))} FROM pq)""", PAIRS))
def _(fx):
    return pairs(fx).select("point_id", *vq("o", sphere.slerp(P, Q, 0.25)))


@query("geo_rotate_axis", ora("point_pairs", f"""
SELECT point_id, {sq('o', 'w')} FROM (
 SELECT point_id, cos(0.7) AS c, sin(0.7) AS s, 1-cos(0.7) AS t,
  (t*qx*qx+c)*px+(t*qx*qy-qz*s)*py+(t*qx*qz+qy*s)*pz AS wx, (t*qx*qy+qz*s)*px+(t*qy*qy+c)*py+(t*qy*qz-qx*s)*pz AS wy,
  (t*qx*qz-qy*s)*px+(t*qy*qz+qx*s)*py+(t*qz*qz+c)*pz AS wz FROM pq)""", PAIRS))
def _(fx):
    return pairs(fx).select("point_id", *vq("o", sphere.rotate_axis(Q, 0.7, P)))


# A ray parameter of any size: up to twenty itself, beyond it its inverse, which stays exact where the ray is nearly parallel.
def far(t: str, into: str, scale: float = 1e6) -> str:
    return f"{S.q(f'CASE WHEN abs({t})<20 THEN {t} END', scale)} AS {into}, {S.q(f'CASE WHEN abs({t})>=20 THEN 1/({t}) END')} AS {into}_inverse"


def far_columns(t, into: str, scale: float = 1e6):
    near = F.abs(t) < 20
    return quantize(F.when(near, t), scale).alias(into), quantize(F.when(~near, F.try_divide(F.lit(1.0), t))).alias(into + "_inverse")


# rays from 3 x p towards q, against the unit sphere and shapes spanned by the pair
RAYS = (PAIRS, f"""rays AS (SELECT point_id, {S.cols('p', 'q')}, {S.lin('o', ('3.0', 'p'))}, {S.lin('d', ('1', 'q'), ('-3.0', 'p'))} FROM pq)""")
O, D = V3.of("o"), V3.of("d")


def rays(fx):
    return put(pairs(fx), o=P * 3.0, d=Q - P * 3.0)


@query("geo_ray_sphere", ora("point_pairs", f"""
SELECT point_id, {S.q('CASE WHEN det>=0 THEN CASE WHEN (-ph-sqrt(det))/d2>=0 THEN (-ph-sqrt(det))/d2 WHEN (-ph+sqrt(det))/d2>=0 THEN (-ph+sqrt(det))/d2 END END')} AS t,
 {S.q('CASE WHEN det>=0 THEN (-ph-sqrt(det))/d2 END')} AS t0, {S.q('CASE WHEN det>=0 THEN (-ph+sqrt(det))/d2 END')} AS t1
FROM (SELECT point_id, {S.dot('d', 'd')} AS d2, {S.dot('o', 'd')} AS ph, ph*ph-({S.dot('o', 'o')}-0.81)*d2 AS det FROM rays)""", *RAYS))
def _(fx):
    zero = V3(0.0, 0.0, 0.0)
    t0, t1 = hits.ray_sphere_both(O, D, zero, 0.9)
    return rays(fx).select("point_id", quantize(hits.ray_sphere(O, D, zero, 0.9)).alias("t"),
                           quantize(t0).alias("t0"), quantize(t1).alias("t1"))


# a section from a to b, where a, b are q rotated a little; the ray may pass on either side
SEC = (*RAYS, f"""sec AS (SELECT *, qx+0.2*py AS ax, qy+0.2*pz AS ay, qz+0.2*px AS az,
 qy*0.9+0.1 AS fx, qx*0.8 AS fy, qz*0.9-0.1 AS fz, {S.section_normal('a', 'f', 'n')} FROM rays)""")
A, B, N = V3.of("a"), V3.of("b"), V3.of("sn")
SECTION = hits.Section.of("s")


def sections(fx):
    df = put(rays(fx), a=Q + V3(C("py"), C("pz"), C("px")) * 0.2, b=V3(C("qy") * 0.9 + 0.1, C("qx") * 0.8, C("qz") * 0.9 - 0.1))
    return put(df, **hits.Section.between(A, B).vectors("s"))


# an independent form of the bounded test: tangents built with normalised up vectors
_TAN = f"""tan_ AS (SELECT *, {S.plane_hit('o', 'd', 'a', 'n')} AS t, {S.lin('h', ('1', 'o'), ('t', 'd'))},
 {S.unit('a', 'ua')}, {S.lin('ab', ('1', 'f'), ('-1', 'a'))}, {S.dot('ab', 'ua')} AS ka, {S.lin('ta', ('1', 'ab'), ('-ka', 'ua'))},
 {S.lin('ha', ('1', 'h'), ('-1', 'a'))}, {S.unit('f', 'ub')}, {S.dot('ab', 'ub')} AS kb, {S.lin('tb', ('-1', 'ab'), ('kb', 'ub'))},
 {S.lin('hb', ('1', 'h'), ('-1', 'f'))}, {S.dot('n', 'd')} AS nd FROM sec)"""


@query("geo_ray_section", ora("point_pairs", f"""
SELECT point_id, {far('t', 'plane_t', 1e4)}, {far('(CASE WHEN nd<=0 THEN t END)', 'front_t', 1e4)},
 {far('(CASE WHEN ' + S.dot('ta', 'ha') + '>=0 AND ' + S.dot('tb', 'hb') + '>=0 THEN t END)', 'section_t', 1e4)} FROM tan_""", *SEC, _TAN))
def _(fx):
    return sections(fx).select(
        "point_id", *far_columns(hits.ray_plane(O, D, SECTION), "plane_t", 1e4),
        *far_columns(hits.ray_plane(O, D, SECTION, cull_back=True), "front_t", 1e4),
        *far_columns(hits.ray_section(O, D, SECTION), "section_t", 1e4))


def _cramer(a, b, c):
    """Determinant with these columns."""
    return f"({a}x*({b}y*{c}z-{b}z*{c}y)-{b}x*({a}y*{c}z-{a}z*{c}y)+{c}x*({a}y*{b}z-{a}z*{b}y))"


@query("geo_ray_triangle", ora("point_pairs", f"""
SELECT point_id, {S.q("CASE WHEN det>=1e-6 AND u>=0 AND v>=0 AND u+v<=1 THEN t END")} AS t FROM (
 SELECT point_id, {S.lin('e', ('1', 'k'), ('-1', 'a'))}, {S.lin('f', ('1', 'c'), ('-1', 'a'))}, {S.lin('g', ('-1', 'd'))}, {S.lin('w', ('1', 'o'), ('-1', 'a'))},
  {_cramer('e', 'f', 'g')} AS det, {_cramer('w', 'f', 'g')}/det AS u, {_cramer('e', 'w', 'g')}/det AS v, {_cramer('e', 'f', 'w')}/det AS t
 FROM (SELECT *, qx+0.4 AS cx, qy-0.1 AS cy, qz+0.2 AS cz FROM
  (SELECT point_id, {S.cols('o', 'd', 'q')}, qx-0.3 AS ax, qy-0.2 AS ay, qz+0.1 AS az, qx+0.1 AS kx, qy+0.4 AS ky, qz-0.1 AS kz FROM rays)))""", *RAYS))
def _(fx):
    a, b, c = (Q + V3(*o) for o in ((-0.3, -0.2, 0.1), (0.1, 0.4, -0.1), (0.4, -0.1, 0.2)))
    return rays(fx).select("point_id", quantize(hits.ray_triangle(O, D, a, b, c)).alias("t"))


@query("geo_ray_wedge", ora("point_pairs", f"""
SELECT point_id, {far("(CASE WHEN u>=0 AND v>=0 THEN t END)", "t", 1e4)} FROM (
 SELECT point_id, {S.lin('g', ('-1', 'd'))}, {_cramer('a', 'f', 'g')} AS det, {_cramer('o', 'f', 'g')}/det AS u,
  {_cramer('a', 'o', 'g')}/det AS v, {_cramer('a', 'f', 'o')}/det AS t FROM sec)""", *SEC))
def _(fx):
    return sections(fx).select("point_id", *far_columns(hits.ray_wedge(O, D, A, B), "t", 1e4))


@query("geo_section_tools", ora("point_pairs", f"""
SELECT point_id, {sq('o', 'w')}, {S.dot('pa', 'n')}>=0 AS side, {far('((b2*e2-c2*d2)/(a2*c2-b2*b2))', 'seg_t', 1e4)} FROM (
 SELECT *, {S.cross('a', 'f', 'm0')}, {S.unit('m0', 'm')}, {S.dot('p', 'm')} AS k, {S.lin('w', ('1', 'p'), ('-k', 'm'))},
  {S.lin('pa', ('1', 'p'), ('-1', 'a'))}, {S.lin('u', ('1', 'f'), ('-1', 'a'))},
  {S.dot('u', 'u')} AS a2, {S.dot('u', 'p')} AS b2, {S.dot('p', 'p')} AS c2, {S.dot('u', 'a')} AS d2, {S.dot('p', 'a')} AS e2 FROM sec)""", *SEC))
def _(fx):
    return sections(fx).select("point_id", *vq("o", hits.project_to_section(P, A, B)), hits.section_side(P, A, N).alias("side"),
                               *far_columns(hits.closest_on_segment(P, A, B), "seg_t", 1e4))


@query("geo_vector_tools", ora("point_pairs", f"""
SELECT point_id, {sq('c', 'w')}, {S.q('sqrt(pow(px-qx,2)+pow(py-qy,2)+pow(pz-qz,2))')} AS dist, {S.q(S.dot('p', 'q'))} AS dot,
 {S.q('px+qx')} AS sum_x FROM (SELECT *, {S.cross('p', 'q', 'w')} FROM pq)""", PAIRS))
def _(fx):
    return pairs(fx).select("point_id", *vq("c", P.cross(Q)), quantize(P.dist(Q)).alias("dist"),
                            quantize(P.dot(Q)).alias("dot"), quantize((P + Q).x).alias("sum_x"))
