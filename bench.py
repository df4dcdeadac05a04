"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from terrasphere import catalog
from terrasphere.catalog.base import Fixtures
from terrasphere.catalog.pyramid import scratch
from terrasphere.fixtures import LATTICE_N
from terrasphere.plans.build import build, update
from terrasphere.session import local_session

HEADLINE = {
    "point_to_cell_level12": "grid_cell_of",
    "cell_summary": "flagship_cell_summary",
    "point_in_polygon": "cov_point_in_polygon",
    "bilinear_mosaic": "ras_mosaic_bilinear",
    "downsample_level": "pyr_downsample",
    "full_pyramid": "pyr_build",
    "tile_stats": "pyr_tile_stats",
    "segment_cell_coverage": "cov_segment_cell_join",
    "cumulative_length": "vec_cumulative_length",
    "palette_mapping": "pal_map_layer",
    "windowed_ingest": "stm_ingest_points",
}


def update_times(spark, sf_dir: str) -> tuple[float, float]:
    """Seconds of the query pyr_update (a build, then a change to a third of the patches), and of its update alone."""
    fx = Fixtures(spark, sf_dir)
    path = scratch(fx, "bench")
    t0 = time.time()
    build(spark, fx.lattice, path, LATTICE_N)
    t1 = time.time()
    changes = fx.lattice.where((F.col("patch") % 3 == 0) & (F.col("gx") % 2 == 0)).withColumn("value", F.col("value") + 100)
    update(spark, path, changes, LATTICE_N).write.format("noop").mode("overwrite").save()
    return round(time.time() - t0, 3), round(time.time() - t1, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for label, name in HEADLINE.items():
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - t0, 3)
    times["pyramid_update"], alone = update_times(spark, sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "update_without_build": alone, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
