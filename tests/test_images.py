"""From images to a pyramid: values, levels, refinement, given coverage and rejects."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from terrasphere.functions.descent import with_scope
from terrasphere.functions.georef import Georef
from terrasphere.operators.cover import image_tile_join
from terrasphere.operators import raster
from terrasphere.operators.grid import level_for
from terrasphere.plans.build import build_images
from terrasphere.session import checkpoint_root

N = 5
IMAGE = ("image_id bigint, ord bigint, gt0 double, gt1 double, gt2 double, gt3 double, gt4 double, gt5 double, size_x int, size_y int, "
         "px_offset double, px_scale double, nodata double, point_sampled boolean")


def image(k, lon, lat, step, size):
    return (k, k, lon, step, 0.0, lat, 0.0, -step, size, size, 0.0, 1.0, -9999.0, True)


def tables(spark, rows, value):
    images = spark.createDataFrame(rows, IMAGE)
    px = [(r[0], x, y, float(value(r[0], x, y))) for r in rows for x in range(r[8] or 0) for y in range(r[9] or 0)]
    return images, spark.createDataFrame(px, "image_id bigint, px int, py int, value double")


def scratch(spark):
    return f"{checkpoint_root(spark)}/images-{uuid.uuid4().hex}"


def positions(spark, pyramid, level):
    """lon, lat in degrees and value of the vertices of one level, by the lattice of their cells."""
    from terrasphere.functions.descent import refine
    from terrasphere.functions.sphere import cart_to_geodetic
    from terrasphere.functions.vec import V3
    from terrasphere.operators.pyramid import tiles_of
    from terrasphere.functions import keys

    tiles = tiles_of(pyramid.where(F.col("level") == level), N)
    tx, ty = keys.tile_xy(F.col("level"), F.col("path"))
    v = refine(with_scope(tiles), N, ["patch", "level", "path"]).withColumns({"gx": tx * (N - 1) + F.col("i"), "gy": ty * (N - 1) + F.col("j")})
    lon, lat, _ = cart_to_geodetic(V3.of(""))
    at = v.select("patch", "level", "gx", "gy", lon.alias("lon"), lat.alias("lat")).dropDuplicates(["patch", "level", "gx", "gy"])
    return at.join(pyramid, ["patch", "level", "gx", "gy"]).collect()


def test_linear_images_come_back_exactly(spark):
    images, px = tables(spark, [image(1, 10.0, 30.0, 1.0, 12)], lambda k, x, y: 100 + 3 * x - 2 * y)
    out, rejected = build_images(spark, images, px, scratch(spark), N)
    assert rejected.count() == 0
    level = images.select(level_for(Georef().finest_resolution(), N)).first()[0]
    rows = positions(spark, out, level)
    assert len(rows) > 50 and out.agg(F.min("level")).first()[0] == 0
    for r in rows:
        # in a point-sampled image the georeference names the centre of the first pixel
        assert abs(r.value - (100 + 3 * (r.lon - 10) - 2 * (30 - r.lat))) < 1e-5


def test_fine_image_inside_a_coarse_one(spark):
    """Beside the fine image, vertices of its tiles hold what the coarse level has there."""
    images, px = tables(spark, [image(1, 0.0, 40.0, 2.0, 20), image(2, 15.0, 25.0, 0.5, 8)], lambda k, x, y: 7.0 if k == 1 else 9.0)
    out, _ = build_images(spark, images, px, scratch(spark), N)
    levels = {r.image_id: r[1] for r in images.select("image_id", level_for(Georef().finest_resolution(), N)).collect()}
    assert levels[2] > levels[1]
    fine = [r.value for r in out.where(F.col("level") == levels[2]).collect()]
    assert set(np.round(fine, 6)) == {7.0, 9.0} and fine.count(9.0) > 3
    coarse = [r.value for r in out.where(F.col("level") == levels[1]).collect()]
    assert 7.0 in coarse and max(coarse) <= 9.0


def test_given_coverage_and_rejects(spark):
    bad = image(3, 0.0, 0.0, 0.0, 4)
    images, px = tables(spark, [image(1, 0.0, 40.0, 1.0, 30), bad, image(4, 5.0, 5.0, 1.0, 4)], lambda k, x, y: 1.0)
    out, rejected = build_images(spark, images, px.where("image_id <> 4"), scratch(spark), N)
    assert {(r.image_id, r.reason) for r in rejected.collect()} == {(3, "no georeference"), (4, "no pixels")}
    assert out.count() > 0
    good = images.where("image_id = 1")
    part = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(((0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)))], "image_id bigint, ord int, x double, y double")
    whole = {tuple(r) for r in image_tile_join(good, 4).collect()}
    some = {tuple(r) for r in image_tile_join(good, 4, coverage=part).collect()}
    assert some < whole and len(some) < len(whole) / 4


def test_long_coverage_is_met_by_its_tiles_edges(spark):
    """A coverage of many vertices gives the tiles of the same outline drawn with few."""
    images, _ = tables(spark, [image(1, 170.0, 40.0, 1.0, 30)], lambda k, x, y: 1.0)
    corners = [(2.0, 2.0), (26.0, 3.0), (20.0, 25.0), (9.0, 12.0)]
    few = [(1, k, x, y) for k, (x, y) in enumerate(corners)]
    many = []
    for (x, y), (u, v) in zip(corners, corners[1:] + corners[:1]):
        many += [(x + (u - x) * t / 5000, y + (v - y) * t / 5000) for t in range(5000)]
    schema = "image_id bigint, ord int, x double, y double"
    a, b = ({tuple(r) for r in image_tile_join(images, 5, coverage=spark.createDataFrame(rows, schema)).collect()}
            for rows in (few, [(1, 10 * k + 3, x, y) for k, (x, y) in enumerate(many)]))
    assert a == b and len(a) > 20


POINT = "point_id bigint, lon_deg double, lat_deg double"


def crowd(spark):
    """Images of several sizes, turned ones, repeated rows, missing orders; pixels that repeat or are missing."""
    rows = [image(k, -20.0 + 7 * (k % 6), 30.0 - 5 * (k % 5), (0.25, 0.5, 2.0)[k % 3], 5 + 9 * (k % 4)) for k in range(12)]
    rows = [(*r[:13], k % 2 == 0) for k, r in enumerate(rows)]
    turned = list(rows[4])
    turned[0], turned[4], turned[6] = 50, 0.1, -0.2
    unordered, null_id = list(rows[2]), list(rows[1])
    unordered[0], unordered[1], null_id[0] = 60, None, None
    rows += [tuple(turned), tuple(unordered), tuple(null_id), rows[3], image(70, 0.0, 0.0, 0.0, 4), image(71, 0.0, 20.0, 1.0, 0)]
    images = spark.createDataFrame(rows, IMAGE)
    px = [(r[0], x, y, None if (x + y) % 7 == 0 else float(x * 100 + y)) for r in rows for x in range(r[8]) for y in range(r[9]) if (x * 31 + y * 17) % 5]
    px += [(3, 1, 1, 5.0), (3, 1, 1, None), (4, None, 2, 1.0)]
    rng = np.random.default_rng(3)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-25, 40, 400), rng.uniform(-30, 35, 400)))]
    points += [(900, -20.0, 30.0), (901, None, 3.0), (None, -6.0, 20.0), (902, float("nan"), 1.0), (5, -13.0, 25.0)]
    return spark.createDataFrame(points, POINT), images, spark.createDataFrame(px, "image_id bigint, px int, py int, value double")


def plain_samples(points, images):
    sx, sy = Georef().system_to_image(F.col("lon_deg"), F.col("lat_deg"))
    return points.crossJoin(images).withColumns({"sx": sx, "sy": sy}).where(F.col("sx").between(0, F.col("size_x") - 1) & F.col("sy").between(0, F.col("size_y") - 1))


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_samples_are_those_of_all_pairs(spark, monkeypatch):
    from terrasphere.operators import sampling

    points, images, px = crowd(spark)
    every = plain_samples(points, images)
    keys = ["point_id", "image_id", "ord"]
    near = raster.nearest(every.select(*keys, "sx", "sy"), px)
    blocks = every.groupBy("image_id", F.floor(F.col("sx") / 4).cast("int").alias("bx"), F.floor(F.col("sy") / 4).cast("int").alias("by")).agg(F.count(F.lit(1)).alias("samples"))
    mosaic = raster.mosaic_latest(near, ["point_id"])
    for most in (sampling.PART_IMAGES, 3):  # whole cells, and cells in parts
        monkeypatch.setattr(sampling, "PART_IMAGES", most)
        monkeypatch.setattr(sampling, "PART_POINTS", 20 * most)
        assert ordered(raster.sample_points(points, images, ["point_id"]).select(*keys, "sx", "sy")) == ordered(every.select(*keys, "sx", "sy"))
        assert ordered(raster.chunk_reads(points, images, 4)) == ordered(blocks)
        for size in (4, 32):
            assert ordered(raster.nearest_at(points, images, px, ["point_id"], size=size).select(*keys, "value")) == ordered(near.select(*keys, "value"))
        assert ordered(raster.mosaic_nearest(points, images, px, ["point_id"])) == ordered(mosaic)


def test_samples_are_dealt_over_the_tasks_and_not_joined(spark):
    """Points came in as many tasks as their file has, each with all images, and samples were shuffled to their pixels."""
    points, images, px = crowd(spark)
    points = points.coalesce(1)
    for df in (raster.sample_points(points, images, ["point_id"]), raster.nearest_at(points, images, px, ["point_id"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan.split("\n")[0] + plan.split("\n")[1]
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
