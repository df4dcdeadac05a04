"""Joins whose pairs are many: pairs are decided where the two sides meet and are not shuffled."""

import math
import random

from pyspark.sql import functions as F

from terrasphere.operators import coverage
from terrasphere.operators import raster as R


def star(n, cx, cy, r, rnd):
    return [(cx + r * (0.4 + 0.6 * rnd.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.4 + 0.6 * rnd.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def odd(px, py, ring):
    c = 0
    for (x, y), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        up = y <= py < y2 and (px - x) * (y2 - y) < (py - y) * (x2 - x)
        down = y2 <= py < y and (px - x2) * (y - y2) < (py - y2) * (x - x2)
        c += up or down
    return c % 2


def rings(rnd):
    out = {k: star(5 + k % 9, rnd.uniform(-90, 90), rnd.uniform(-60, 60), 10 ** rnd.uniform(-3, 2), rnd) for k in range(30)}
    out[30] = star(coverage.SHORT_RING + 40, 3.0, 4.0, 50.0, rnd)
    return out


def test_points_in_short_and_long_rings_and_repeated_keys(spark):
    rnd = random.Random(1)
    shapes = rings(rnd)
    at = [(k, rnd.uniform(-100, 100), rnd.uniform(-80, 80)) for k in range(400)]
    for k, ring in enumerate(shapes.values()):  # points about the small rings, on vertices, without a position, with a key that comes again
        at += [(1000 + k, ring[0][0], ring[0][1]), (1100 + k, sum(x for x, _ in ring) / len(ring), sum(y for _, y in ring) / len(ring)), (k, ring[1][0] + 1e-4, ring[1][1])]
    at += [(5000, None, 1.0), (None, 3.0, 4.0)]
    polys = spark.createDataFrame([(k, i, x, y) for k, r in shapes.items() for i, (x, y) in enumerate(r)], "poly bigint, ord int, x double, y double")
    got = coverage.point_in_polygon(spark.createDataFrame(at, "point bigint, px double, py double"), polys, "point", "poly").collect()
    total = {}
    for p, px, py in at:
        if px is not None:
            for k, ring in shapes.items():
                total[p, k] = total.get((p, k), 0) + odd(px, py, ring)
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {k for k, n in total.items() if n % 2}


def test_pairs_of_points_and_short_rings_are_not_grouped(spark):
    shapes = {k: v for k, v in rings(random.Random(2)).items() if len(v) < coverage.SHORT_RING}
    polys = spark.createDataFrame([(k, i, x, y) for k, r in shapes.items() for i, (x, y) in enumerate(r)], "poly bigint, ord int, x double, y double")
    points = spark.range(50).select(F.col("id").alias("point"), F.col("id").cast("double").alias("px"), F.lit(1.0).alias("py"))
    plan = coverage.point_in_polygon(points, polys, "point", "poly")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]


def sampled(spark, rnd):
    """Overlapping images of several blocks and sizes with holes, one without any pixel, and points with one on a far border."""
    g = "image_id bigint, ord bigint, gt0 double, gt1 double, gt2 double, gt3 double, gt4 double, gt5 double, size_x int, size_y int, point_sampled boolean"
    im = [(k, 7 * k % 13, rnd.uniform(-8, 8), 0.25 * (1 + k % 3), 0.0, rnd.uniform(0, 8), 0.0, -0.5, 20 + 9 * k, 50 - 3 * k, k % 2 == 1) for k in range(12)]
    px = [(i[0], x, y, rnd.uniform(1, 50)) for i in im[:-1] for x in range(i[8]) for y in range(i[9]) if rnd.random() < 0.9]
    at = [(k, rnd.uniform(-8, 20), rnd.uniform(-15, 8)) for k in range(150)] + [(150, im[1][2] + (im[1][8] - 1) * im[1][1], im[1][3] - (im[1][9] - 1) * 0.5), (151, None, 0.0), (None, 1.0, 1.0)]
    return spark.createDataFrame(at, "point_id bigint, lon_deg double, lat_deg double"), spark.createDataFrame(im, g), spark.createDataFrame(px, "image_id bigint, px int, py int, value double")


def rounded(df):
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_samples_on_cells_equal_samples_by_image(spark):
    points, images, px = sampled(spark, random.Random(3))
    keys = ["point_id", "image_id", "ord"]
    by_image = R.bilinear_parts(R.sample_points(points, images, ["point_id"]), px, keys, ["value"])
    on_cells = R.bilinear_at(points, images, px, ["point_id"], ["value"])
    got = rounded(on_cells)
    assert len(got) > 150 and got == rounded(by_image)


def test_mosaic_without_hidden_images_equals_that_of_all(spark):
    points, images, px = sampled(spark, random.Random(4))
    every = R.bilinear_parts(R.sample_points(points, images, ["point_id"]), px, ["point_id", "image_id", "ord"], ["value"])
    seen = R.unhidden_parts(points, images, px, "point_id")
    assert rounded(R.mosaic_blend(seen, ["point_id"], chunk=4)) == rounded(R.mosaic_blend(every, ["point_id"], chunk=4))
    assert seen.count() < every.count()


def test_pixels_without_a_place_are_left_out(spark):
    points, images, px = sampled(spark, random.Random(5))
    lost = spark.createDataFrame([(1, None, 2, 9.0), (1, 3, None, 9.0)], px.schema)
    assert rounded(R.bilinear_at(points, images, px.union(lost), ["point_id"], ["value"])) == rounded(R.bilinear_at(points, images, px, ["point_id"], ["value"]))


def kept(df, path):
    """The rows as a table whose size Spark knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_rings_of_images_and_tiles_are_not_broadcast(spark, tmp_path):
    from terrasphere.operators import cover

    images = kept(sampled(spark, random.Random(6))[1].drop("ord"), tmp_path / "images")
    plan = cover.image_tile_join(images, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_lattices_and_samples_are_not_broadcast(spark, tmp_path):
    from terrasphere.plans.build import blended

    _, images, px = sampled(spark, random.Random(7))
    tiles = spark.createDataFrame([(1, 0, 2, 5)], "image_id bigint, patch int, level int, path bigint")
    lattice = spark.createDataFrame([(0, 2, 5, k, k, 0.1 * k, 1.0) for k in range(9)], "patch int, level int, path bigint, gx bigint, gy bigint, lon_deg double, lat_deg double")
    under = lattice.select("patch", "level", "gx", "gy", F.lit(1.0).alias("value"))
    plan = blended(*(kept(df, tmp_path / str(k)) for k, df in enumerate((tiles, lattice, images, px, under))))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def nearby(spark, rnd, lines=40, per=12):
    """Queries and lines around one place; two queries share a key, some points come twice, a query and a point have no place."""
    from terrasphere.functions import sphere
    from terrasphere.functions.vec import put
    from terrasphere.operators import lines as L

    at = [(k, i + 1, 10 + rnd.gauss(0, 0.3), 20 + rnd.gauss(0, 0.3), rnd.uniform(0, 500)) for k in range(lines) for i in range(per)]
    at += [(lines + k, i, lon, lat, e) for k in range(3) for _, i, lon, lat, e in at[:per]] + [(lines + 5, 1, None, 1.0, 0.0)]
    points = L.positions(spark.createDataFrame(at, "line_id bigint, ord bigint, lon_deg double, lat_deg double, elev double"))
    asked = [(k, 10 + rnd.gauss(0, 0.5), 20 + rnd.gauss(0, 0.5)) for k in range(120)] + [(3, 10.1, 20.1), (500, at[5][2], at[5][3]), (501, None, 3.0), (502, -100.0, 3.0)]
    queries = put(spark.createDataFrame(asked, "k bigint, lon double, lat double"), q=sphere.geodetic_to_cart(F.col("lon"), F.col("lat"), F.lit(0.0))).select("k", "qx", "qy", "qz")
    return queries, points, L.segments(points)


def test_nearest_point_and_segment_equal_the_least_of_all_candidates(spark, monkeypatch):
    from terrasphere.operators import nearest as NR

    monkeypatch.setattr(NR, "PART_THINGS", 50)  # cubes in parts
    queries, points, segs = nearby(spark, random.Random(8))
    for radius in (2000.0, 30000.0):
        for got, every, one in ((NR.nearest_control_point(queries, points, ["k"], radius), NR.point_candidates(queries, points, radius), "ord"),
                                (NR.nearest_segment(queries, segs, ["k"], radius), NR.segment_candidates(queries, segs, radius), "seg")):
            want = every.groupBy("k").agg(F.min(F.struct("dist", "line_id", one)).alias("b")).select("k", "b.*")
            assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 20


def test_selected_lines_equal_those_of_all_candidates(spark):
    from terrasphere.operators import nearest as NR

    queries, points, segs = nearby(spark, random.Random(9))
    for bias, most in ((0.5, 4000.0), (1.5, 4000.0), (1.0, 30000.0)):
        best, far = {}, most * max(bias, 1 / bias)
        for kind, rows in ((0, NR.point_candidates(queries, points, far)), (1, NR.segment_candidates(queries, segs, far))):
            for r in rows.collect():
                pair = best.setdefault((r.k, r.line_id), [math.inf, math.inf])
                pair[kind] = min(pair[kind], r.dist)
        want = {}
        for (k, line), (p, s) in best.items():
            d, kind = (p, "point") if p * bias <= s else (s, "segment")
            if d <= most:
                want[k] = min(want.get(k, (math.inf, 0, "")), (d, line, kind))
        got = NR.select(queries, points, segs, ["k"], bias, most).collect()
        assert {r.k: (r.dist, r.line_id, r.kind) for r in got} == want and len(got) == len(want) > 20


def test_candidates_of_a_dense_place_do_not_leave_the_task_that_meets_them(spark):
    from terrasphere.operators import nearest as NR

    queries, points, segs = nearby(spark, random.Random(10))
    assert NR.segment_candidates(queries, segs, 30000.0).count() > 50 * queries.count()
    assert NR.met_segments(queries, segs, ["k"], 30000.0, nearest=True).count() < 12 * queries.count()
    plan = NR.nearest_segment(queries, segs, ["k"], 30000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_nearest_anywhere_in_dense_and_empty_regions(spark, monkeypatch):
    from terrasphere.operators import nearest as NR

    queries, points, _ = nearby(spark, random.Random(11))
    sent = []
    tree = NR._nearest_in_tree
    monkeypatch.setattr(NR, "_nearest_in_tree", lambda q, *more: sent.append(q.count()) or tree(q, *more))
    got = {r.k: r.dist for r in NR.nearest_control_point(queries, points, ["k"]).collect()}
    at = [(r.x, r.y, r.z) for r in points.collect() if r.x is not None]
    want = {}
    for r in queries.collect():
        if r.qx is not None:
            want[r.k] = min(want.get(r.k, math.inf), min(math.dist((r.qx, r.qy, r.qz), p) for p in at))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-6) for k in want)
    assert sent == [1]  # of the queries only the far one descends the tree


def test_blocks_of_pixels_come_once_and_points_ask_around(spark, monkeypatch):
    """A block lay on every cell under it, and cells in parts sorted both sides by cell first."""
    from terrasphere.operators import sampling

    points, images, px = sampled(spark, random.Random(12))
    monkeypatch.setattr(sampling, "PART_IMAGES", 2)
    monkeypatch.setattr(sampling, "PART_POINTS", 40)
    px = px.withColumn("other", F.when(F.col("px") % 3 > 0, F.col("value") * 2))
    keys = ["point_id", "image_id", "ord"]
    tiles = sampling.image_tiles(images, 8)
    assert sampling.tiles_on_cells(tiles, 8).count() == tiles.count() > 100
    want = rounded(R.bilinear_parts(R.sample_points(points, images, ["point_id"]), px, keys, ["value", "other"]))
    got = R.bilinear_at(points, images, px, ["point_id"], ["value", "other"], size=8)
    assert rounded(got) == want and len(want) > 150
    assert "MapInArrow" in "".join(got._jdf.queryExecution().optimizedPlan().toString().split("\n")[:2])
    seen = R.unhidden_parts(points, images, px, "point_id", size=8)
    every = R.bilinear_parts(R.sample_points(points, images, ["point_id"]), px, keys, ["value"])
    assert rounded(R.mosaic_blend(seen, ["point_id"])) == rounded(R.mosaic_blend(every, ["point_id"]))


def test_cells_that_a_polygon_holds_whole_are_not_tested(spark):
    """Every pair of a point and a polygon on a cell was tested with the polygon's edges. Rings with a missing place hold no cell whole."""
    rnd = random.Random(13)
    shapes = {k: star(12, 0.0, 0.0, 40.0 + k, rnd) for k in range(18)}
    # level edges through cells and along them
    shapes |= {18: [(-31.0, -29.0), (33.0, -29.0), (33.0, 31.0), (-31.0, 31.0)], 19: [(-32.0, -32.0), (32.0, -32.0), (32.0, 0.0), (0.0, 0.0), (0.0, 32.0), (-32.0, 32.0)]}
    rows = [(k, i, x, y) for k, r in shapes.items() for i, (x, y) in enumerate(r)] + [(50, i, x, y) for i, (x, y) in enumerate([(-30.0, -30.0), (30.0, -30.0), (30.0, 30.0), (None, None), (-30.0, 30.0)])]
    polys = spark.createDataFrame(rows, "poly bigint, ord int, x double, y double")
    near, whole, _, _ = coverage.rings_in_cells(polys, "poly")
    assert whole.count() > 2 * near.where("poly < 50").count() / 3 and not whole.where("poly = 50").count()
    at = [(k, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for k in range(1500)]
    points = spark.createDataFrame(at, "point bigint, px double, py double")
    pairs = points.crossJoin(coverage.ring_edges(polys, "poly").withColumnRenamed("ord", "_o"))
    want = pairs.groupBy("point", "poly").agg(F.sum(coverage.crossing(F.col("px"), F.col("py"))).alias("n"), F.first("px").alias("px"), F.first("py").alias("py"))
    want = want.where("n % 2 = 1 AND (poly < 50 OR px BETWEEN -30 AND 30 AND py BETWEEN -30 AND 30)").select("point", "poly")
    got = coverage.point_in_polygon(points, polys, "point", "poly")
    assert rounded(got) == rounded(want) and got.count() > 5000
