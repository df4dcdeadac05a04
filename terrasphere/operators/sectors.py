"""Faults of any length: points find the sectors that hold them, and are displaced along them.

Sectors are ordered along their fault. Runs of sixteen, runs of those, and so on carry the box of their separating normals;
a point descends only into runs in which a normal may still change its side, so it meets some sectors for every level of the
tree and never the fault as a whole. Box bounds are sums of the same products in the same order as the tests they
stand for, so rounding cannot lose a sector. A displacement walks in rounds, up to 64 sectors a round, over the points that still move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.functions.vec import V3, num, put, ratio
from terrasphere.session import cut_lineage

FAN = 4  # bits of a child's number
STRIDE = 6  # bits of a sector's number in its stretch
FEW = 4096  # rows that every task gets


def _meet(points: DataFrame, rows: DataFrame, keys: list[str], most: int = FEW) -> DataFrame:
    """Inner join in which few rows go to every task: where runs or sectors are few, very many points share a key."""
    return points.join(F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows, keys)


def sectors(plane_rows: DataFrame, separating: DataFrame, cut: str = "slope") -> DataFrame:
    """A row per sector (fault_id, k from 0, is_last): cutting plane n*, w, strike s*, dip vector t*, separating
    normals l* and r* on its sides, and h*, the normal of the fault's first plane."""
    n, dist, dip = ("g", "g_dist", "gd") if cut == "slope" else ("f", "f_dist", "fd")
    left = separating.select("fault_id", "ord", *V3.of("m").cols("l"))
    right = separating.select("fault_id", (F.col("ord") - 1).alias("ord"), *V3.of("m").cols("r"))
    head = plane_rows.where("ord = 1").select("fault_id", *V3.of(n).cols("h"))
    own = plane_rows.select(
        "fault_id", "ord", (F.col("ord") - 1).cast("int").alias("k"), (F.col("ord") == F.col("n_points") - 1).alias("is_last"),
        *V3.of(n).cols("n"), F.col(dist).alias("w"), *V3.of("s").cols("s"), *V3.of(dip).cols("t"))
    return cut_lineage(own.join(left, ["fault_id", "ord"]).join(right, ["fault_id", "ord"]).join(head, "fault_id").drop("ord"))


def _tree(sector_rows: DataFrame) -> list[DataFrame]:
    """Runs of sectors by level, from runs of 16 sectors up to below the root, with the box lo*, hi* of their normals."""
    last = sector_rows.agg(F.max("k")).first()[0] or 0
    box = {f"{name}{a}": pick("l" + a, "r" + a) for a in "xyz" for name, pick in (("lo", F.least), ("hi", F.greatest))}
    nodes = sector_rows.select("fault_id", F.col("k").alias("node"), (F.col("k") == 0).alias("has_first"), F.col("is_last").alias("has_last"), *[c.alias(name) for name, c in box.items()])
    levels = []
    while last >> (FAN * (len(levels) + 1)):
        nodes = nodes.groupBy("fault_id", F.shiftright("node", FAN).alias("node")).agg(
            F.max("has_first").alias("has_first"), F.max("has_last").alias("has_last"),
            *[(F.min if name.startswith("lo") else F.max)(name).alias(name) for name in box])
        levels.append(nodes)
    return levels


def holding(points: DataFrame, sector_rows: DataFrame, ids: list[str], open_ends: bool = True) -> DataFrame:
    """(ids, k, d) for every sector of its fault that holds a point (ids, fault_id, p*); d is the distance to its plane.

    With open ends the first and the last sector of a fault reach on beyond their outer separating planes. Points of a fault without
    planes have no row.
    """
    p = V3.of("p")
    low, high = (
        sum((pick(F.col("lo" + a) * F.col("p" + a), F.col("hi" + a) * F.col("p" + a)) for a in "yz"), pick(F.col("lox") * F.col("px"), F.col("hix") * F.col("px")))
        for pick in (F.least, F.greatest))
    edge = (lambda c: F.col(c)) if open_ends else (lambda c: F.lit(False))
    carried = [*dict.fromkeys([*ids, "fault_id", "px", "py", "pz"])]
    reached = points.select(*carried, F.lit(0).alias("_parent"))
    for nodes in reversed(_tree(sector_rows)):
        below = nodes.withColumn("_parent", F.shiftright("node", FAN))
        met = _meet(reached, below, ["fault_id", "_parent"]).where((edge("has_first") | (high > 0)) & (edge("has_last") | (low < 0)))
        reached = met.select(*carried, F.col("node").alias("_parent"))
    own = sector_rows.withColumn("_parent", F.shiftright("k", FAN)).drop(*[c for c in ids if c != "fault_id"])
    first = (F.col("k") == 0) if open_ends else F.lit(False)
    met = _meet(reached, own, ["fault_id", "_parent"]).where((first | (V3.of("l").dot(p) > 0)) & (edge("is_last") | (V3.of("r").dot(p) < 0)))
    return met.select(*ids, "k", (V3.of("n").dot(p) + F.col("w")).alias("d"))


def nearest_plane(points: DataFrame, sector_rows: DataFrame, ids: list[str]) -> DataFrame:
    """Points with k, the sector holding them whose plane is nearest in front of them; -1 for none.

    Of equal distances the first sector counts. ids tell points apart.
    """
    found = holding(points, sector_rows, ids).where((F.col("d") > 0) & (F.col("d") < 1e9))
    best = found.groupBy(*ids).agg(F.min(F.struct("d", "k")).alias("_best")).select(*ids, F.col("_best.k").alias("k"))
    return points.join(best, ids, "left").withColumn("k", F.coalesce("k", F.lit(-1)))


def compression_factor(points: DataFrame, sector_rows: DataFrame, ids: list[str], falloff: float, coloring: float = 1.0) -> DataFrame:
    """Points with factor = coloring * max(0, falloff - distance to the nearest bounded sector) / falloff."""
    found = holding(points, sector_rows, ids, open_ends=False).where(F.col("d") >= 0)
    near = F.least(F.coalesce("_near", F.lit(1e9)), F.lit(1e9))
    factor = num(coloring) * F.greatest(F.lit(0.0), num(falloff) - near) / float(falloff)
    return points.join(found.groupBy(*ids).agg(F.min("d").alias("_near")), ids, "left").withColumn("factor", factor).drop("_near")


STATE = "struct<x:double,y:double,z:double,rest:double,k:int,c:double>"


def _onward(forward: bool):
    """One sector of a walk: on to the separating plane at its end, or as far as the rest allows."""
    sgn = 1.0 if forward else -1.0

    def step(acc: Column, e: Column) -> Column:
        p, s = V3(acc["x"], acc["y"], acc["z"]), V3.field(e["s"]) * sgn
        side = V3.field(e["side"])
        lam = ratio(-side.dot(p), side.dot(s))
        walk = F.coalesce(F.when(lam > 0, F.least(lam, acc["rest"])), F.lit(0.0))
        q = p + s * walk
        moved = F.struct(q.x.alias("x"), q.y.alias("y"), q.z.alias("z"), (acc["rest"] - walk).alias("rest"),
                         (acc["k"] + int(sgn)).alias("k"), (acc["c"] + walk * s.dot(-V3.field(e["h"]))).alias("c"))
        more = (acc["k"] == e["k"]) & (acc["rest"] > 0) & ~e["end"]
        return F.when(more, moved.cast(STATE)).otherwise(acc)

    return step


def shift(points: DataFrame, sector_rows: DataFrame, ids: list[str], strike_amount: float, dip_amount: float) -> DataFrame:
    """Displace points (ids, fault_id, p*, nearest plane k): q*, the place u* before the dip, and raw compression.

    Walks along the strike through successive sectors, then along the dip of the last one. Points with k = -1 stay.
    There are as many rounds as the longest walk has stretches of 64 sectors; each carries only points that still move.
    """
    forward = strike_amount >= 0
    sgn = 1.0 if forward else -1.0
    end = F.col("is_last") if forward else F.col("k") == 0
    entry = F.struct("k", end.alias("end"), V3.of("s").struct().alias("s"), V3.of("r" if forward else "l").struct().alias("side"), V3.of("h").struct().alias("h"))
    # at most 64 sectors a stretch
    stretches = sector_rows.groupBy("fault_id", F.shiftright("k", STRIDE).alias("_at")).agg(F.sort_array(F.collect_list(entry), asc=forward).alias("_stretch"))
    stretches = cut_lineage(stretches)
    who = [*dict.fromkeys([*ids, "fault_id"])]
    start = F.struct(*[F.col("p" + a).alias(a) for a in "xyz"], F.lit(abs(float(strike_amount))).alias("rest"), F.col("k").alias("k"), F.lit(0.0).alias("c"))
    moving = points.where("k >= 0").select(*who, start.cast(STATE).alias("_s"))
    there = None
    while True:
        met = _meet(moving.withColumn("_at", F.shiftright(F.col("_s.k"), STRIDE)), stretches, ["fault_id", "_at"], FEW >> STRIDE)
        met = cut_lineage(met.select(*who, "_at", F.aggregate("_stretch", F.col("_s"), _onward(forward)).alias("_s")))
        on = (F.shiftright(F.col("_s.k"), STRIDE) != F.col("_at")) & (F.col("_s.rest") > 0)
        arrived = met.where(~on).select(*who, "_s")
        there = arrived if there is None else there.unionByName(arrived)
        moving = met.where(on).select(*who, "_s")
        if moving.isEmpty():
            break
    last = sector_rows.select("fault_id", F.col("k").alias("_k"), *V3.of("s").cols("_s"), *V3.of("t").cols("_t"), *V3.of("h").cols("_h"))
    out = there.select(*who, F.col("_s.k").alias("_k"), *[F.col("_s." + a).alias("_" + a) for a in "xyz"], F.greatest(F.col("_s.rest"), F.lit(0.0)).alias("_rest"), F.col("_s.c").alias("_c"))
    out = _meet(out, last, ["fault_id", "_k"])
    s = V3.of("_s") * sgn
    out = put(out, _u=V3.of("_") + s * F.col("_rest"))
    out = put(out, _q=V3.of("_u") + V3.of("_t") * float(dip_amount)).withColumn("_c", F.col("_c") + F.col("_rest") * s.dot(-V3.of("_h")))
    moved = out.select(*who, *[f"_{v}{a}" for v in "uq" for a in "xyz"], "_c")
    df = points.join(moved, who, "left")
    fresh = {f"{v}{a}": F.coalesce(f"_{v}{a}", f"p{a}") for v in "qu" for a in "xyz"} | {"compression": F.coalesce("_c", F.lit(0.0))}
    return df.withColumns(fresh).drop(*[f"_{v}{a}" for v in "uq" for a in "xyz"], "_c")
