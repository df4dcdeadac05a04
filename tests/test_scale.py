"""Ray descents and pyramid kernels that were reworked to scale: small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasphere.functions import descent
from terrasphere.functions.vec import V3
from terrasphere.operators import pyramid, terrain

R = 6371000.0
RAY = "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double"


def test_rays_hit_a_coarse_tile_beside_finer_ones(spark):
    """A cell of level 1 is not stored, one of its children is: the others show the high tile of level 0."""
    n = 17
    rows = [(0, 0, x, y, 500000.0) for x in range(n) for y in range(n)] + [(0, 2, x, y, 0.0) for x in range(n) for y in range(n)]
    heights = spark.createDataFrame(rows, "patch int, level int, gx bigint, gy bigint, value double")
    u = descent.unit(descent.scopes(np.array([0]), np.array([2]), np.array([12])).sum(1))[0]
    along = descent.unit(np.cross(u, [0.3, 0.2, 0.9])[None])[0]
    o = u * (R + 495000.0) + along * 2 * R
    rays = spark.createDataFrame([(1, *map(float, (*o, *-along)))], RAY)
    hit = terrain.intersect(rays, heights, n).collect()
    assert len(hit) == 1 and (hit[0].patch, hit[0].level, hit[0].path) == (0, 0, 0)
    assert np.sqrt(hit[0].hx**2 + hit[0].hy**2 + hit[0].hz**2) == pytest.approx(R + 497500, abs=2600)


def test_a_ray_leaves_the_cells_under_the_terrain(spark):
    """A ray through the middle of the globe is above no cell between its ends."""
    at = 2 * R - float(np.sqrt(R**2 - 4e12))  # where it enters
    spans = [(at - 1e5, False), (at, True), (at + 1e5, False), (2 * R, False), (4 * R - at, True), (4 * R - at + 1e5, False)]
    rows = spark.createDataFrame([(i, 2e6, 0.0, 2 * R, 0.0, 0.0, -1.0, t, t + 10.0) for i, (t, _) in enumerate(spans)],
                                 RAY + ", t_in double, t_out double")
    met = terrain.in_shell(V3.of("o"), V3.of("d"), F.lit(0.0), F.lit(1000.0), F.lit(0.001), R)
    assert [r[1] for r in rows.select("ray_id", met).orderBy("ray_id").collect()] == [ok for _, ok in spans]


LATTICE = "patch int, level int, gx bigint, gy bigint, value double"


def test_blocks_sum_as_single_vertices_do(spark):
    """Vertices around the borders of blocks, some twice, against sums written out."""
    rng, n, level = np.random.default_rng(8), 17, 4
    top = (n - 1) << level
    spots = [(int(x), int(y)) for x, y in rng.integers(100, 156, (400, 2))] + [(0, 0), (top, top), (0, 128), (top - 1, 3)]
    rows = [(int(k % 2) if k % 7 else None, level, x, y, float(k % 13) if k % 11 else None) for k, (x, y) in enumerate(spots + spots[:40])]
    df = spark.createDataFrame(rows, LATTICE)
    want: dict = {}
    for p, _, x, y, v in rows:
        if v is not None:
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if 0 <= 2 * x + dx <= 2 * top and 0 <= 2 * y + dy <= 2 * top:
                        want.setdefault((p, level + 1, 2 * x + dx, 2 * y + dy), []).append(v)
    got = {(r.patch, r.level, r.gx, r.gy): r.value for r in pyramid.upsample(df, n).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(np.mean(v)) for k, v in want.items())
    kernel = (0.05, 0.25, 0.4, 0.2, 0.1)
    total: dict = {}
    for p, _, x, y, v in rows:
        for px in range(max(0, (x - 2) // 2), min(top // 2, (x + 3) // 2) + 1) if v is not None else ():
            for py in range(max(0, (y - 2) // 2), min(top // 2, (y + 3) // 2) + 1):
                if abs(x - 2 * px) <= 2 and abs(y - 2 * py) <= 2:
                    w = kernel[x - 2 * px + 2] * kernel[y - 2 * py + 2]
                    s = total.setdefault((p, level - 1, px, py), [0.0, 0.0])
                    s[0], s[1] = s[0] + w * v, s[1] + w
    down = {(r.patch, r.level, r.gx, r.gy): (r.numerator, r.weight, r.value) for r in pyramid.downsample(df, n, kernel, with_weight=True).collect()}
    assert down.keys() == total.keys()
    assert all(down[k] == pytest.approx((s, w, s / w)) for k, (s, w) in total.items())


def test_kernels_shuffle_vertices_not_taps(spark):
    """What a vertex spreads is not shuffled: 4,096 vertices go to their blocks and nowhere else."""
    df = spark.range(4096).selectExpr("0 patch", "8 level", "1000 + id % 64 gx", "1000 + id div 64 gy", "cast(id as double) value")
    for made in (pyramid.upsample(df, 17), pyramid.downsample(df, 17, "lanczos5")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "HashAggregate" not in plan


def test_refined_vertices_come_once(spark):
    n = 5
    df = spark.createDataFrame([(0, 1, x, y, float(x + 10 * y)) for x in range(9) for y in range(9)], LATTICE)
    tiles = pyramid.tiles_of(df, n)
    needed = spark.createDataFrame([(0, 2, p) for p in (0, 4, 12, 15)], "patch int, level int, path bigint")
    got = [(r.gx, r.gy) for r in pyramid.refine_missing(df, needed, tiles, n).collect()]
    want = set()
    for p in (0, 4, 12, 15):
        tx, ty = (p & 1) * 2 + (p >> 2 & 1), (p >> 1 & 1) * 2 + (p >> 3 & 1)
        want |= {(tx * 4 + i, ty * 4 + j) for i in range(5) for j in range(5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_segments_meet_roots_as_all_pairs_do():
    """near_roots names the pairs that near_cap keeps of all segments and roots, antipodal ends and ends at the centre too."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 3)) * R, rng.normal(size=(300, 3)) * R
    b[:100] = a[:100] + rng.normal(size=(100, 3)) * 1e5
    b[100], b[101], a[102] = -a[100], a[101], 0.0
    row, patch = np.repeat(np.arange(300), 30), np.tile(np.arange(30), 300)
    with np.errstate(all="ignore"):
        ok = descent.near_cap(descent.ROOT_CORNERS[patch], a[row], b[row])
        got = descent.near_roots(a, b)
    assert np.array_equal(got[0], row[ok]) and np.array_equal(got[1], patch[ok]) and 300 < ok.sum() < 9000
