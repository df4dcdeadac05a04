"""View-dependent selection of cells, for many views at once.

Cells carry KEY, a bounding sphere (bx, by, bz, br); views carry view_id, an eye (e*), a
focus centre (f*), focus_radius, and six planes as an array of struct<x,y,z,w> with inward
normals. Views are a small dimension next to cells; Spark broadcasts them while they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere import TILE_RESOLUTION
from terrasphere.functions import keys
from terrasphere.functions.vec import V3, put, ratio
from terrasphere.operators.ordered import dense_order, top_k
from terrasphere.session import cut_lineage

KEY = ["patch", "level", "path"]
SHELL = 100_000.0  # metres of distance ordered in one task


def frustum(views: DataFrame, half_angle_deg: float, near: float, far: float) -> DataFrame:
    """Views (e*, f*) with the six planes of a square frustum from the eye towards the focus."""
    e, f = V3.of("e"), V3.of("f")
    df = put(views, _d=(f - e).unit())
    d = V3.of("_d")
    # an up vector that is never parallel to the view
    axis = F.when(F.abs(d.z) < 0.9, F.lit(1.0)).otherwise(F.lit(0.0))
    df = put(df, _r=d.cross(V3(1.0 - axis, F.lit(0.0), axis)).unit())
    df = put(df, _u=V3.of("_r").cross(d))
    r, u = V3.of("_r"), V3.of("_u")
    c, s = math.cos(math.radians(half_angle_deg)), math.sin(math.radians(half_angle_deg))
    sides = [r * c + d * s, r * -c + d * s, u * c + d * s, u * -c + d * s]
    planes = [F.struct(n.x.alias("x"), n.y.alias("y"), n.z.alias("z"), (-n.dot(e)).alias("w")) for n in sides]
    planes.append(F.struct(d.x.alias("x"), d.y.alias("y"), d.z.alias("z"), (-d.dot(e) - near).alias("w")))
    planes.append(F.struct((-d.x).alias("x"), (-d.y).alias("y"), (-d.z).alias("z"), (d.dot(e) + far).alias("w")))
    return df.withColumn("planes", F.array(*planes)).drop(*[f"{p}{a}" for p in ("_d", "_r", "_u") for a in "xyz"])


def in_frustum(center: V3, radius: Column) -> Column:
    """Sphere against all six planes (generated code: no lambda over the array)."""
    tests = []
    for k in range(6):
        p = F.col("planes")[k]
        tests.append(V3.field(p).dot(center) + p["w"] >= -radius)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def is_visible(offset: V3 | None = None) -> Column:
    """Visibility of a cell's bounding sphere. With a fault displacement (offset) the sphere
    counts at both places with doubled radius."""
    b, r = V3.of("b"), F.col("br")
    if offset is None:
        return in_frustum(b, r)
    return in_frustum(b, r * 2.0) | in_frustum(b + offset, r * 2.0)


def projected_radius(screen_scale: float) -> Column:
    """Radius of the bounding sphere on the screen; negative when the eye is inside it."""
    d = V3.of("b").dist(V3.of("e"))
    return F.when(d <= F.col("br"), F.lit(-1.0)).otherwise(ratio(F.col("br") * float(screen_scale), d))


def value(screen_scale: float, scale: float = 1.0, bias: float = 0.0, n: int = TILE_RESOLUTION) -> Column:
    """log of the projected radius per sample; beyond the focus it falls with the squared distance."""
    pr = projected_radius(screen_scale)
    far = V3.of("b").dist(V3.of("f")) - F.col("br")
    q = ratio(far, F.col("focus_radius"))
    reduced = F.when(far > F.col("focus_radius"), pr / (q * q)).otherwise(pr)
    lod = F.when(pr < 0, F.lit(3.4028234663852886e38)).otherwise(reduced)
    return F.log(lod / (n * 0.55)) * float(scale) + float(bias)


def cut(cells: DataFrame, views: DataFrame, lod: Callable[[], Column], threshold: float = 1.0,
        visible: Callable[[], Column] | None = None, max_level: int | None = None) -> DataFrame:
    """Tree cut per view: (view_id, KEY, visible, lod, wants, b*, e*)."""
    return reached(cells, views, lod, threshold, visible, max_level).where("NOT split").drop("split")


def reached(cells: DataFrame, views: DataFrame, lod: Callable[[], Column], threshold: float = 1.0,
            visible: Callable[[], Column] | None = None, max_level: int | None = None) -> DataFrame:
    """Every cell a view meets on its way down to the cut, evaluated: visible, lod, split, wants.

    A visible cell with lod above the threshold is replaced by its children (split) if all
    four exist, otherwise it stays and its missing children are wanted. Invisible cells are
    culled with all below them. The frontier meets cells on their key; a step adds one level.
    """
    visible = visible or is_visible
    body = ["bx", "by", "bz", "br"]
    child_of = cells.where(F.col("level") > 0).select(
        "patch", (F.col("level") - 1).cast("int").alias("level"), keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("path"))
    kids = child_of.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_kids"))
    tree = cut_lineage(cells.select(*KEY, *body).join(kids, KEY, "left").withColumn("_kids", F.coalesce("_kids", F.lit(0))))
    depth = max_level if max_level is not None else tree.agg(F.max("level")).first()[0]
    vcols = [c for c in views.columns]
    frontier = tree.where(F.col("level") == 0).crossJoin(views)
    out = None
    for level in range((depth or 0) + 1):
        here = frontier.withColumns({"visible": visible(), "lod": lod()})
        deep = F.col("visible") & (F.col("lod") > threshold)
        split = deep & (F.col("_kids") == 4)
        emitted = here.select("view_id", *KEY, "visible", "lod", split.alias("split"), (deep & (F.col("_kids") < 4) & (F.col("_kids") > 0)).alias("wants"),
                              *["b" + a for a in "xyz"], *["e" + a for a in "xyz"])
        out = emitted if out is None else out.unionByName(emitted)
        if level == depth:
            break
        go = here.where(split).select(*vcols, *KEY).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
        path = keys.child(F.col("level"), F.col("path"), F.col("_k"))[1]
        go = go.withColumns({"path": path, "level": F.lit(level + 1)}).drop("_k")
        frontier = go.join(tree.where(F.col("level") == level + 1), KEY)
        if level % 3 == 2:
            frontier = cut_lineage(frontier)
    return out


def order_by_distance(front: DataFrame, k: int | None = None) -> DataFrame:
    """Cells (view_id, KEY, b*, e*) with their distance and rank, farthest first; k keeps the first ones."""
    df = front.withColumn("dist", V3.of("b").dist(V3.of("e")))
    order = [F.col("dist").desc(), *[F.col(c) for c in KEY]]
    if k is not None:
        return top_k(df, ["view_id"], order, k)
    return dense_order(df, "view_id", order, F.floor(-F.col("dist") / SHELL), into="rank")


def missing_tiles(front: DataFrame, cells: DataFrame) -> DataFrame:
    """Children that split candidates want (view_id, KEY, lod) but that do not exist."""
    kids = front.withColumn("child", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    level, path = keys.child(F.col("level"), F.col("path"), F.col("child"))
    want = kids.select("view_id", "lod", "child", "patch", level.cast("int").alias("level"), path.alias("path"))
    return want.join(cells.select(*KEY), KEY, "left_anti")


def coalesce_requests(requests: DataFrame, k: int = 8, keys_: tuple[str, ...] = ("patch", "level", "path")) -> DataFrame:
    """One request per cell with its smallest lod; the k most urgent by |lod|."""
    one = requests.groupBy(*keys_).agg(F.min("lod").alias("lod"))
    order = [F.abs("lod"), *[F.col(c) for c in keys_]]
    return top_k(one.withColumn("_all", F.lit(0)), ["_all"], order, k).drop("_all")
