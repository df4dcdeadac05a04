"""Faults of any length against the folded array of short ones and against numpy."""

import numpy as np
import pytest

from terrasphere.functions.vec import V3
from terrasphere.operators import fault, sectors
from terrasphere.session import cut_lineage

R = 6371000.0
POINT = "id int, fault_id int, px double, py double, pz double"


def trace(n, wave=3.0):
    lon = np.radians(np.linspace(-60, 60, n))
    lat = np.radians(wave * np.sin(np.linspace(0, 12, n)))
    return R * np.stack([np.cos(lon) * np.cos(lat), np.sin(lon) * np.cos(lat), np.sin(lat)], 1)


def on_fault(spark, xyz, fault_id=1):
    pts = spark.createDataFrame([(fault_id, k + 1, *map(float, p)) for k, p in enumerate(xyz)], "fault_id int, ord bigint, x double, y double, z double")
    return cut_lineage(fault.planes(pts, 60.0))


def around(rng, xyz, m, spread=3e5):
    return xyz[rng.integers(0, len(xyz), m)] + rng.normal(size=(m, 3)) * spread


@pytest.mark.parametrize("strike", [900000.0, -900000.0, 0.0])
def test_sectors_agree_with_the_array(spark, strike):
    xyz = trace(200)
    pl = on_fault(spark, xyz)
    sep = fault.separating_planes(pl)
    sec = sectors.sectors(pl, sep)
    p = around(np.random.default_rng(1), xyz, 300)
    df = spark.createDataFrame([(k, 1, *map(float, v)) for k, v in enumerate(p)], POINT)
    near = cut_lineage(sectors.nearest_plane(df, sec, ["id"]))
    got = {r.id: r for r in sectors.shift(near, sec, ["id"], strike, 50.0).collect()}
    factor = {r.id: r.factor for r in sectors.compression_factor(df, sec, ["id"], 3e6, 0.7).collect()}
    old = fault.with_planes(df, fault.plane_array(pl, sep)).withColumn("k", fault.nearest_plane(V3.of("p")))
    old = old.withColumn("factor", fault.compression_factor(V3.of("p"), 3e6, 0.7))
    want = fault.shift(old, strike, 50.0).collect()
    assert len(got) == len(want) == 300
    for r in want:
        g = got[r.id]
        assert (g.k, factor[r.id]) == (r.k, r.factor)
        assert np.allclose([g.qx, g.qy, g.qz, g.compression], [r.qx, r.qy, r.qz, r.compression], rtol=1e-12, atol=1e-6)


def test_a_fault_of_100000_points(spark):
    n = 100_000
    xyz = trace(n)
    sec = sectors.sectors(pl := on_fault(spark, xyz), fault.separating_planes(pl))
    rows = sec.orderBy("k").toPandas()
    assert len(rows) == n - 1
    normal, left, right, strike = (rows[[v + a for a in "xyz"]].to_numpy() for v in "nlrs")
    rng = np.random.default_rng(2)
    p = around(rng, xyz, 400, 1e5)
    df = spark.createDataFrame([(k, 1, *map(float, v)) for k, v in enumerate(p)], POINT)
    near = cut_lineage(sectors.nearest_plane(df, sec, ["id"]))
    held = {}
    for r in sectors.holding(df, sec, ["id"]).collect():
        held.setdefault(r.id, set()).add(r.k)
    got = {r.id: r.k for r in near.collect()}
    for k, v in enumerate(p):
        inside = (left @ v > 0) & (right @ v < 0)
        inside[0], inside[-1] = right[0] @ v < 0, left[-1] @ v > 0
        # signs closer than rounding may differ between the two ways of adding up
        close = (np.abs(left @ v) < 1e-6) | (np.abs(right @ v) < 1e-6)
        assert {i for i in np.flatnonzero(inside & ~close)} <= held.get(k, set()) <= {i for i in np.flatnonzero(inside | close)}
        d = normal @ v + rows.w.to_numpy()
        d[~inside | (d <= 0) | (d >= 1e9)] = np.inf
        if not close.any():
            assert got[k] == (int(d.argmin()) if np.isfinite(d).any() else -1)
    # a walk over some three hundred sectors: every point ends in the sector where its amount is used up
    moved = [r for r in sectors.shift(near, sec, ["id"], 40000.0, 0.0).collect() if 0 <= r.k < n - 1000]
    assert moved
    for r in moved:
        q, rest, k = np.array([r.px, r.py, r.pz]), 40000.0, r.k
        while rest > 0 and k < n - 2:
            lam = -(right[k] @ q) / (right[k] @ strike[k])
            step = min(lam, rest) if lam > 0 else 0.0
            q, rest, k = q + strike[k] * step, rest - step, k + 1
        q = q + strike[k] * max(rest, 0.0)
        assert np.allclose([r.qx, r.qy, r.qz], q, atol=1e-3)


def test_no_planes_no_points_and_equal_distances(spark):
    xyz = trace(40)
    sec = sectors.sectors(pl := on_fault(spark, xyz), fault.separating_planes(pl))
    elsewhere = spark.createDataFrame([(1, 2, *map(float, xyz[3])), (2, None, *map(float, xyz[3])), (3, 1, None, 1.0, 1.0)], POINT)
    out = sectors.shift(sectors.nearest_plane(elsewhere, sec, ["id"]), sec, ["id"], 1e5, 10.0).collect()
    assert sorted((r.id, r.k, r.qy == r.py) for r in out) == [(1, -1, True), (2, -1, True), (3, -1, True)]
    none = elsewhere.where("false")
    assert sectors.shift(sectors.nearest_plane(none, sec, ["id"]), sec, ["id"], 1e5, 10.0).count() == 0
    lone = sectors.sectors(one := on_fault(spark, xyz[:1]), fault.separating_planes(one))
    assert {r.k for r in sectors.nearest_plane(elsewhere, lone, ["id"]).collect()} == {-1}


def test_points_of_one_fault_do_not_meet_in_one_task(spark):
    """Points of a fault shared the number of its first run, and all came into the task of that key."""
    xyz = trace(24)
    pl = on_fault(spark, xyz)
    sec = sectors.sectors(pl, fault.separating_planes(pl))
    p = around(np.random.default_rng(2), xyz, 200)
    df = cut_lineage(spark.createDataFrame([(k, 1, *map(float, v)) for k, v in enumerate(p)], POINT).repartition(4, "id"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    near = sectors.nearest_plane(df, sec, ["id"])
    for df_ in (near, sectors.shift(cut_lineage(near), sec, ["id"], 900000.0, 50.0)):
        assert "SortMergeJoin [fault_id" not in plan(df_) and "BroadcastHashJoin [fault_id" in plan(df_)
    few = {tuple(r) for r in near.collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sectors._meet, "__defaults__", (1,))
        assert {tuple(r) for r in sectors.nearest_plane(df, sec, ["id"]).collect()} == few
