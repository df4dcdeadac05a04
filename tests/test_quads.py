"""Single quads against the whole grid of their tiles."""

import numpy as np
from pyspark.sql import functions as F

from terrasphere.functions.descent import with_scope
from terrasphere.operators import terrain

KEY = ["patch", "level", "path"]


def test_quads_at_equal_the_whole_grid(spark):
    tiles = spark.createDataFrame([(3, 0, 0), (7, 2, 9), (7, 2, 9), (29, 5, 700)], "patch int, level int, path bigint")
    heights = spark.range(0, 17 * 17).selectExpr("3 AS patch", "0 AS level", "id % 17 AS gx", "floor(id / 17) AS gy", "CAST(id * 3.5 AS double) AS value").where("gx <> 4")
    want = terrain.quads(terrain.extruded(with_scope(tiles.distinct()), heights, 17, 2.0, 11.0), 17).orderBy(*KEY, "cx", "cy").toPandas()
    cells = tiles.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(15))))
    got = terrain.quads_at(cells, heights, 17, 2.0, 11.0).orderBy(*KEY, "cx", "cy").toPandas()
    names = [f"v{k}{a}" for k in range(4) for a in "xyz"]
    assert len(got) == len(want) == 3 * 256
    assert np.array_equal(got[[*KEY, "cx", "cy"]], want[[*KEY, "cx", "cy"]])
    assert np.abs(got[names].to_numpy() - want[names].to_numpy()).max() < 1e-6
    assert terrain.quads_at(cells.where("false"), heights, 17).count() == 0
