"""Fault displacement along a line of control points (fault_id, ord, x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.functions.sphere import rotate_axis
from terrasphere.functions.vec import V3, num, put, ratio
from terrasphere.operators.ordered import with_neighbors

SALTS = 64


def _projected(points: DataFrame) -> DataFrame:
    """Points moved to the mean radius of their fault."""
    mean = points.groupBy("fault_id").agg(F.avg(V3.of("").norm()).alias("_r"), F.count(F.lit(1)).alias("n_points"))
    p = points.join(mean, "fault_id")
    return put(p, p=V3.of("") * ratio(F.col("_r"), V3.of("").norm())).select("fault_id", "ord", "n_points", "px", "py", "pz")


def _oblique(a: V3, b: V3, strike: V3, angle_deg) -> V3:
    """Normal of the plane through a..b tilted from the vertical one about the strike."""
    flat = strike.cross(a).unit()
    return rotate_axis(strike, (90.0 + float(angle_deg)) * math.pi / 180.0, flat)


def planes(points: DataFrame, dip_deg: float) -> DataFrame:
    """Fault (90 degrees) and slope planes per segment: strike s*, normals f*, g*, dip vectors fd*,
    gd*, and signed distances. A fault with fewer than two points has none."""
    p = _projected(points)
    seg = with_neighbors(p, "fault_id", lead={"px": "qx", "py": "qy", "pz": "qz"}).where(F.col("qx").isNotNull())
    a, b, s = V3.of("p"), V3.of("q"), V3.of("s")
    seg = put(seg, s=(b - a).unit())
    seg = put(seg, f=_oblique(a, b, s, 90.0).unit(), g=_oblique(a, b, s, dip_deg).unit())
    seg = put(seg, fd=s.cross(V3.of("f")).unit(), gd=s.cross(V3.of("g")).unit())
    return seg.withColumns({"f_dist": -(a.dot(V3.of("f"))), "g_dist": -(a.dot(V3.of("g")))})


def separating_planes(plane_rows: DataFrame) -> DataFrame:
    """One plane through the centre per control point (fault_id, ord, m*), across the fault:
    interior ones use the mean fault normal of both sides."""
    both = with_neighbors(plane_rows, "fault_id", lag={"fx": "ux", "fy": "uy", "fz": "uz"})
    f, u = V3.of("f"), V3.of("u")
    mean = V3(*[F.coalesce((c + d) * 0.5, c) for c, d in zip((f.x, f.y, f.z), (u.x, u.y, u.z))])
    starts = put(both, w=mean, c=V3.of("p")).select("fault_id", "ord", "wx", "wy", "wz", "cx", "cy", "cz")
    last = plane_rows.where(F.col("ord") == F.col("n_points") - 1)
    end = put(last, w=V3.of("f"), c=V3.of("q")).select("fault_id", (F.col("ord") + 1).alias("ord"), "wx", "wy", "wz", "cx", "cy", "cz")
    both = starts.unionByName(end)
    reach = V3.of("c") + V3.of("w").unit() * 1e6
    return put(put(both, k=reach), m=(V3.of("k").cross(V3.of("c"))).unit()).select("fault_id", "ord", "mx", "my", "mz")


def fault_center(points: DataFrame) -> DataFrame:
    p = _projected(points)
    return p.groupBy("fault_id").agg(*[F.avg("p" + a).alias("m" + a) for a in "xyz"])


def plane_distance(p: V3, normal: V3, distance: Column) -> Column:
    return normal.dot(p) - distance


def plane_center(normal: V3, distance: Column) -> V3:
    return normal * (-distance)


def shift_vector(strike: V3, dip: V3, strike_amount, dip_amount) -> V3:
    return strike * num(strike_amount) + dip * num(dip_amount)


def linear_translation(points: DataFrame, strike_amount: float) -> DataFrame:
    """Displacement along the line from the first to the last point; zero with fewer than two."""
    ends = points.groupBy("fault_id").agg(
        F.min_by(F.struct("x", "y", "z"), "ord").alias("a"), F.max_by(F.struct("x", "y", "z"), "ord").alias("b"), F.count(F.lit(1)).alias("n"))
    d = (V3.field(F.col("b")) - V3.field(F.col("a"))).unit() * float(strike_amount)
    some = F.col("n") > 1
    return ends.select("fault_id", *[F.when(some, c).otherwise(F.lit(0.0)).alias("l" + k) for c, k in zip((d.x, d.y, d.z), "xyz")])


def segment_compression(plane_rows: DataFrame, strike_amount: float) -> DataFrame:
    """Signed fourth root of the normal part of each later segment's strike on the first slope plane."""
    first = plane_rows.where("ord = 1").select("fault_id", *[F.col("g" + a).alias("h" + a) for a in "xyz"])
    s = plane_rows.join(first, "fault_id").where(F.col("ord") > 1)
    up = V3.of("p").unit()
    line = V3.of("q") - V3.of("p")
    s = put(s, t=(line - up * up.dot(line)).unit())
    c = V3.of("h").dot(V3.of("t"))
    root = F.sqrt(F.sqrt(F.abs(c)))
    sign = F.when(c > 0, 1.0).otherwise(-1.0) * (-1.0 if strike_amount < 0 else 1.0)
    return s.select("fault_id", F.col("ord").alias("segment"), (root * sign).alias("compression"))


def plane_array(plane_rows: DataFrame, separating: DataFrame, cut: str = "slope") -> DataFrame:
    """One row per fault: the ordered planes as an array, however many control points it has.

    Each entry holds the cutting plane n, its distance, the strike, the dip vector and the
    separating planes on both sides.
    """
    n, dist, dip = ("g", "g_dist", "gd") if cut == "slope" else ("f", "f_dist", "fd")
    left = separating.select("fault_id", "ord", *[F.col("m" + a).alias("l" + a) for a in "xyz"])
    right = separating.select("fault_id", (F.col("ord") - 1).alias("ord"), *[F.col("m" + a).alias("r" + a) for a in "xyz"])
    j = plane_rows.join(left, ["fault_id", "ord"]).join(right, ["fault_id", "ord"])
    vec = lambda v, name: V3.of(v).struct().alias(name)
    entry = F.struct("ord", vec(n, "n"), F.col(dist).alias("w"), vec("s", "strike"), vec(dip, "dip"), vec("l", "left"), vec("r", "right"))
    return j.groupBy("fault_id").agg(F.array_sort(F.collect_list(entry)).alias("planes"))


def _signed(e: Column, p: V3, which: str) -> Column:
    v = V3.field(e.getField(which))
    return v.dot(p) + (e.getField("w") if which == "n" else F.lit(0.0))


def with_planes(points: DataFrame, arrays: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Attach the plane array. Without a key there is one fault: points are dealt over copies of its row, so neither
    a broadcast nor one task has to hold them all."""
    if key:
        return points.join(arrays, key)
    copies = arrays.select("planes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, "_salt").drop("_salt")


def nearest_plane(p: V3) -> Column:
    """Index of the plane nearest in front of p among those whose separating planes hold it; -1 for none.

    The first and the last sector are open at their outer ends.
    """
    last = F.size("planes") - 1
    def step(acc, e):
        d = _signed(e, p, "n")
        i = acc["i"]
        inside = (d > 0) & (d < acc["d"]) & ((i == 0) | (_signed(e, p, "left") > 0)) & ((i == last) | (_signed(e, p, "right") < 0))
        return F.struct((i + 1).alias("i"), F.when(inside, d).otherwise(acc["d"]).alias("d"), F.when(inside, i).otherwise(acc["k"]).alias("k"))
    start = F.struct(F.lit(0).alias("i"), F.lit(1e9).alias("d"), F.lit(-1).alias("k"))
    return F.aggregate("planes", start, step, lambda acc: acc["k"])


def compression_factor(p: V3, falloff: float, coloring: float = 1.0) -> Column:
    """coloring * max(0, falloff - distance to the nearest bounded sector) / falloff."""
    def step(acc, e):
        d = _signed(e, p, "n")
        inside = (d >= 0) & (_signed(e, p, "left") > 0) & (_signed(e, p, "right") < 0)
        return F.when(inside & (d < acc), d).otherwise(acc)
    near = F.aggregate("planes", F.lit(1e9), step)
    return F.lit(float(coloring)) * F.greatest(F.lit(0.0), F.lit(float(falloff)) - near) / float(falloff)


def shift(points: DataFrame, strike_amount: float, dip_amount: float) -> DataFrame:
    """Displace points (p*, with planes and nearest plane k): q* and raw compression.

    Walks along the strike through successive sectors, then along the dip of the last one.
    """
    forward = strike_amount >= 0
    sgn = 1.0 if forward else -1.0
    last = F.size("planes") - 1
    first_n = V3.field(F.element_at("planes", 1)["n"])
    start = F.struct(
        F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.lit(abs(float(strike_amount))).alias("rest"),
        F.col("k").alias("k"), F.lit(0.0).alias("c"), F.lit(False).alias("end"))
    typ = "struct<x:double,y:double,z:double,rest:double,k:int,c:double,end:boolean>"

    def step(acc, _):
        e = F.get("planes", acc["k"])
        s = V3.field(e["strike"]) * sgn
        p = V3(acc["x"], acc["y"], acc["z"])
        more = (acc["rest"] > 0) & ((acc["k"] < last) if forward else (acc["k"] > 0))
        side = V3.field(e["right" if forward else "left"])
        lam = ratio(-side.dot(p), side.dot(s))
        walk = F.when(lam > 0, F.least(lam, acc["rest"])).otherwise(F.lit(0.0))
        walk = F.coalesce(walk, F.lit(0.0))
        q = p + s * walk
        gain = walk * s.dot(-first_n)
        moved = F.struct(q.x.alias("x"), q.y.alias("y"), q.z.alias("z"), (acc["rest"] - walk).alias("rest"),
                         (acc["k"] + (1 if forward else -1)).alias("k"), (acc["c"] + gain).alias("c"), acc["end"].alias("end"))
        return F.when(more, moved.cast(typ)).otherwise(acc)

    def finish(acc):
        e = F.get("planes", acc["k"])
        s = V3.field(e["strike"]) * sgn
        rest = F.greatest(acc["rest"], F.lit(0.0))
        q = V3(acc["x"], acc["y"], acc["z"]) + s * rest
        r = q + V3.field(e["dip"]) * float(dip_amount)
        return F.struct(r.x.alias("x"), r.y.alias("y"), r.z.alias("z"), (acc["c"] + rest * s.dot(-first_n)).alias("c"),
                        q.x.alias("ux"), q.y.alias("uy"), q.z.alias("uz"))

    walked = F.aggregate("planes", start.cast(typ), step, finish)
    df = points.withColumn("_w", F.when(F.col("k") >= 0, walked))
    keep = lambda f, c: F.coalesce(F.col("_w." + f), F.col(c))
    return df.withColumns({"qx": keep("x", "px"), "qy": keep("y", "py"), "qz": keep("z", "pz"),
                           "compression": F.coalesce("_w.c", F.lit(0.0))}).drop("_w")


def split_triangles(tris: DataFrame, n: V3, w: Column) -> DataFrame:
    """Cut triangles (a*, b*, c*) at the plane n.p + w = 0.

    Output rows carry side 'stay' (negative) or 'move' and one to three triangles per
    input. A vertex on the plane counts as moving.
    """
    a, b, c = V3.of("a"), V3.of("b"), V3.of("c")
    df = tris.withColumns({"_da": n.dot(a) + w, "_db": n.dot(b) + w, "_dc": n.dot(c) + w})
    bits = sum(F.when(F.col(d) < 0, k).otherwise(0) for d, k in (("_da", 1), ("_db", 2), ("_dc", 4)))
    df = df.withColumn("_bits", bits)
    def cut(u, v, du, dv):
        return u + (v - u) * ratio(F.col(du), F.col(du) - F.col(dv))
    df = put(df, _ab=cut(a, b, "_da", "_db"), _bc=cut(b, c, "_db", "_dc"), _ca=cut(c, a, "_dc", "_da"))
    ab, bc, ca = V3.of("_ab"), V3.of("_bc"), V3.of("_ca")
    cases = {
        0: [("move", a, b, c)], 7: [("stay", a, b, c)],
        1: [("stay", a, ab, ca), ("move", ab, b, c), ("move", ab, c, ca)],
        2: [("stay", b, bc, ab), ("move", bc, c, a), ("move", bc, a, ab)],
        4: [("stay", c, ca, bc), ("move", ca, a, b), ("move", ca, b, bc)],
        3: [("stay", b, bc, ca), ("stay", b, ca, a), ("move", bc, c, ca)],
        5: [("stay", a, ab, bc), ("stay", a, bc, c), ("move", ab, b, bc)],
        6: [("stay", c, ca, ab), ("stay", c, ab, b), ("move", ca, a, ab)],
    }
    def pack(items):
        return F.array(*[
            F.struct(F.lit(s).alias("side"), *[x for i, v in enumerate(vs) for x in v.cols(f"t{i}")]) for s, *vs in items])
    expr = None
    for k, items in cases.items():
        cond = F.col("_bits") == k
        expr = F.when(cond, pack(items)) if expr is None else expr.when(cond, pack(items))
    keep = [x for x in tris.columns if x not in {f"{v}{d}" for v in "abc" for d in "xyz"}]
    return df.select(*keep, F.inline(expr))
