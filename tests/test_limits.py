"""Sizes and depths beyond what the test tables hold."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasphere.functions.descent import locate, patch_index, scopes, unit
from terrasphere.functions.vec import V3
from terrasphere.operators import fault, lines, palette, pyramid, terrain
from terrasphere.plans.build import build, update
from terrasphere.session import checkpoint_root
from terrasphere.sources import manifest, pixels, pyramid_store
from terrasphere.sources.pyramid_store import read_pyramid

LATTICE = "patch int, level int, gx bigint, gy bigint, value double"


def scratch(spark):
    return f"{checkpoint_root(spark)}/limits-{uuid.uuid4().hex}"


def test_long_fault_is_displaced(spark):
    lon = np.radians(np.linspace(-40, 40, 200))
    lat = np.radians(3 * np.sin(np.linspace(0, 12, 200)))
    xyz = 6371000.0 * np.stack([np.cos(lon) * np.cos(lat), np.sin(lon) * np.cos(lat), np.sin(lat)], 1)
    pts = spark.createDataFrame([(1, k + 1, *map(float, p)) for k, p in enumerate(xyz)], "fault_id int, ord bigint, x double, y double, z double")
    pl = fault.planes(pts, 60.0)
    arr = fault.plane_array(pl, fault.separating_planes(pl))
    planes = arr.first()["planes"]
    assert len(planes) == 199
    beside = [(k, *map(float, xyz[k] * 1.0 + np.array([0, 0, 20000.0]))) for k in range(5, 195, 10)]
    df = fault.with_planes(spark.createDataFrame(beside, "id int, px double, py double, pz double"), arr)
    out = fault.shift(df.withColumn("k", fault.nearest_plane(V3.of("p"))), 1000.0, 50.0).collect()
    dot = lambda v, p: v["x"] * p[0] + v["y"] * p[1] + v["z"] * p[2]
    moved = 0
    for r in out:
        p, best, want = (r.px, r.py, r.pz), 1e9, -1
        for i, e in enumerate(planes):
            d = dot(e["n"], p) + e["w"]
            if 0 < d < best and (i == 0 or dot(e["left"], p) > 0) and (i == 198 or dot(e["right"], p) < 0):
                best, want = d, i
        assert r.k == want
        moved += want > 64 and abs(r.qx - r.px) + abs(r.qy - r.py) > 100
    assert moved > 0 and len(out) == len(beside)


def test_positions_on_a_deep_level(spark):
    rng = np.random.default_rng(1)
    p = unit(rng.normal(size=(50, 3)))
    patch = patch_index(p)
    path = locate(patch, p, np.full(50, 23))
    middle = unit(scopes(patch, np.full(50, 23), path).sum(axis=1))
    ix = sum(((path >> (2 * k)) & 1) << (22 - k) for k in range(23))
    iy = sum(((path >> (2 * k + 1)) & 1) << (22 - k) for k in range(23))
    df = spark.createDataFrame([(k, *map(float, m)) for k, m in enumerate(middle)], "id int, px double, py double, pz double")
    got = {r.id: r for r in terrain.lattice_position(df, 5, 21).collect()}
    for k in range(50):
        assert got[k].patch == patch[k] and abs(got[k].fx - ix[k] - 0.5) < 1e-4 and abs(got[k].fy - iy[k] - 0.5) < 1e-4


def test_points_find_their_finest_tile(spark):
    p = spark.createDataFrame([(1, 1.0, 0.2, 0.1)], "id int, px double, py double, pz double")
    cell = terrain.with_finest(p, spark.range(30).selectExpr("cast(id as int) patch", "0 level", "0L path"), ["id"], 6).first()
    assert cell.level == 0
    deep = spark.createDataFrame([(cell.patch, 0, 0)] + [(cell.patch, 1, k) for k in range(4)], "patch int, level int, path bigint")
    assert terrain.with_finest(p, deep, ["id"], 6).first().level == 1


def test_lists_nested_to_any_depth_and_cycles(spark):
    rows = [(f"l{k}.list", 1, f"l{k + 1}.list") for k in range(20)] + [("l20.list", 1, "data"), ("a.list", 1, "b.list"), ("b.list", 1, "a.list")]
    lists = spark.createDataFrame(rows, "list_path string, line_no bigint, value string")
    out = manifest.layer_manifest(lists, spark.createDataFrame([(1, "l0.list")], "root_id int, list_path string")).collect()
    assert [(r.kind, r.path) for r in out] == [("dataset", "data")]
    with pytest.raises(Exception, match="leads back to itself"):
        manifest.layer_manifest(lists, spark.createDataFrame([(1, "a.list")], "root_id int, list_path string")).collect()


def test_ids_with_a_huge_one_in_use(spark):
    used = spark.createDataFrame([(1,), (2,), (5,), (10**12,)], "id bigint")
    new = spark.createDataFrame([(k,) for k in range(10, 14)], "k bigint")
    assert sorted(r.id for r in lines.allocate_ids(new, "k", used).collect()) == [3, 4, 6, 7]
    dense = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert sorted(r.id for r in lines.allocate_ids(new, "k", dense).collect()) == [3, 4, 5, 6]
    assert sorted(r.id for r in lines.allocate_ids(new, "k", dense.where("id > 5")).collect()) == [1, 2, 3, 4]


def test_long_ring_unwraps(spark):
    n = 1_000_000  # seven turns round the globe
    ring = spark.range(n).selectExpr("1 as key", "id + 1 as ord", f"id * 14 * pi() / {n} as u", "0.1D as lat")
    wrapped = ring.withColumn("lon", F.expr("u - 2 * pi() * floor((u + pi()) / (2 * pi()))"))
    out = lines.unwrap_rings(wrapped.select("key", "ord", "lon", "lat"), "key").join(ring.select("ord", "u"), "ord")
    worst = out.agg(F.max(F.abs(F.col("lon") - F.col("u"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert worst.n == n and worst.m < 1e-6


def test_leaving_a_pole_adds_a_vertex(spark):
    rows = [(1, 1, 0.5, 1.0), (1, 2, 9.9, np.pi / 2), (1, 3, 2.0, 1.0)]
    out = lines.unwrap_rings(spark.createDataFrame(rows, "key int, ord bigint, lon double, lat double"), "key").orderBy("ord", "part").collect()
    assert [(r.ord, r.part, round(r.lon, 6), round(r.lat, 4)) for r in out] == [(1, 1, 0.5, 1.0), (2, 1, 0.5, 1.5708), (3, 0, 2.0, 1.5708), (3, 1, 2.0, 1.0)]


def test_tiles_of_the_default_size(spark):
    px = spark.range(256 * 256 * 2).selectExpr("cast(id % 512 as int) px", "cast(id div 512 as int) py", "cast(id as double) value", "7L image_id").where("value <> 5")
    tiles = pixels.tiles_from_pixels(px.select("image_id", "px", "py", "value")).collect()
    assert len(tiles) == 2 and all(len(t["values"]) == 65536 for t in tiles)
    left = next(t for t in tiles if t.tile_x == 0)["values"]
    assert left[5] is None and left[6] == 6.0 and left[256] == 512.0


@pytest.mark.parametrize("kernel", ["tent", "lanczos5", "point"])
def test_update_equals_a_full_build(spark, kernel):
    root, n = scratch(spark), 5
    rows = [(0, 3, x, y, float((x * 7 + y * 3) % 11)) for x in range(33) for y in range(33)]
    base = spark.createDataFrame(rows, LATTICE)
    build(spark, base, f"{root}/a", n, kernel=kernel)
    some = F.expr("gx between 12 and 13 and gy between 20 and 21")
    update(spark, f"{root}/a", base.where(some).withColumn("value", F.col("value") + 50), n, kernel=kernel)
    build(spark, base.withColumn("value", F.when(some, F.col("value") + 50).otherwise(F.col("value"))), f"{root}/b", n, kernel=kernel)
    a, b = read_pyramid(spark, f"{root}/a"), read_pyramid(spark, f"{root}/b")
    assert a.count() == b.count() > 1000 and a.exceptAll(b).count() == 0


def test_small_change_touches_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(pyramid_store, "BLOCK", 8)
    root, n = scratch(spark), 5
    rows = [(p, 3, x, y, 1.0) for p in (0, 1) for x in range(33) for y in range(33)]
    build(spark, spark.createDataFrame(rows, LATTICE), root, n)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}

    before = files()
    update(spark, root, spark.createDataFrame([(0, 3, 3, 3, 9.0)], LATTICE), n)
    after = files()
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 4 and len(before) > 50  # one block on each of four levels
    assert read_pyramid(spark, root).where("level = 3 and gx = 3 and gy = 3 and patch = 0").first().value == 9.0


def test_empty_palette_gives_no_colour(spark):
    none = spark.createDataFrame([], "value double, r double, g double, b double, a double")
    out = palette.interpolate(spark.createDataFrame([(1.0,), (None,)], "value double"), none).collect()
    assert len(out) == 2 and all(r.r is None for r in out)
    mapped = palette.map_layer(spark.createDataFrame([(1.0,)], "value double"), none).collect()
    assert [(r.r, r.a) for r in mapped] == [(0.0, 0.0)]


def test_fed_vertices_cover_what_a_wide_kernel_reaches(spark):
    one = spark.createDataFrame([(0, 1, 4, 4)], "patch int, level int, gx bigint, gy bigint")
    assert {(r.gx, r.gy) for r in pyramid.fed_vertices(one, 17, "tent").collect()} == {(2, 2)}
    assert len(pyramid.fed_vertices(one, 17, "lanczos5").collect()) == 64


def test_nearest_control_point_half_a_globe_away(spark):
    from terrasphere.operators.nearest import nearest_control_point

    rng = np.random.default_rng(5)
    crowd = unit(rng.normal(size=(400, 3)) * 0.01 + np.array([1.0, 0.2, 0.1])) * (6371000.0 + rng.uniform(-9000, 9000, (400, 1)))
    p = np.r_[crowd, crowd[:50], [[-6400000.0, 10.0, 3.0]]]
    points = spark.createDataFrame([(k % 7, k, *map(float, v)) for k, v in enumerate(p)] + [(9, 1, None, 0.0, 0.0)], "line_id int, ord int, x double, y double, z double")
    asked = np.r_[unit(rng.normal(size=(60, 3))) * 6371000.0, [[-6371000.0, 0.0, 0.0], [6371000.0, 0.0, 0.0], [1.0, 2.0, 3.0]], crowd[:3]]
    queries = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(asked)] + [(99, None, 0.0, 0.0)], "id int, qx double, qy double, qz double")
    got = {r.id: r for r in nearest_control_point(queries, points, ["id"]).collect()}
    assert sorted(got) == list(range(len(asked)))
    for k, q in enumerate(asked):
        d = np.sqrt(((p - q) ** 2).sum(axis=1))
        assert abs(got[k].dist - d.min()) < 1e-3
        assert (got[k].line_id, got[k].ord) in {(i % 7, i) for i in np.flatnonzero(d < d.min() + 1e-3)}
    one = nearest_control_point(queries, points.limit(0), ["id"])
    assert one.collect() == []


def test_manifest_numbers_nested_lists_in_place(spark):
    """Lists named several times and in several lists, copies of lines, palettes that reach over list borders; entries are not shuffled."""
    text = {"/p/r.list": ["a", "x.pal", "n.list", "b", "n.list", "", "# no", "m.list", "c"], "/p/n.list": ["d", "y.pal", "m.list", "e", "none.list"],
            "/p/m.list": ["f", "z.pal", "g", "h.cfg"], "/p/s.list": ["m.list", "i"]}
    rows = [(p, k, v) for p, vs in text.items() for k, v in enumerate(vs) for _ in range(2 if (p, k) in (("/p/r.list", 4), ("/p/m.list", 0), ("/p/m.list", 1)) else 1)]

    def walk(path, at):
        for p, k, v in rows:
            if p == path and v and v[0] != "#":
                q = "/p/" + v
                if v.endswith(".list"):
                    yield from walk(q, (*at, k))
                else:
                    yield (*at, k), q
    want = []
    for root, path in ((1, "/p/r.list"), (2, "/p/s.list"), (3, "/p/m.list")):
        palette = None
        for ord_, (_, q) in enumerate(sorted(walk(path, ())), 1):
            kind = {"pal": "palette", "cfg": "settings"}.get(q.rpartition(".")[2], "dataset")
            palette = q if kind == "palette" else palette
            want.append((root, ord_, kind, q, palette if kind == "dataset" else None))
    lists = spark.createDataFrame(rows, "list_path string, line_no bigint, value string")
    roots = spark.createDataFrame([(1, "/p/r.list"), (2, "/p/s.list"), (3, "/p/m.list")], "root_id int, list_path string")
    out = manifest.layer_manifest(lists, roots)
    assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan.split("Join")[0]
