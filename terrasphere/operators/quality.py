"""Statistics and consistency reports over pyramids and line coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasphere.functions import keys
from terrasphere.functions.descent import SCOPE_NAMES, with_scope
from terrasphere.functions.vec import V3
from terrasphere.operators.grid import segment_intersects, with_side_sections

KEY = ["patch", "level", "path"]


def tile_stats(cells: DataFrame, bridge: DataFrame) -> DataFrame:
    """tiles, tiles with lines, segments and the most segments in one tile."""
    per = bridge.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return cells.select(*KEY).distinct().join(per, KEY, "left").agg(
        F.count(F.lit(1)).alias("tiles"), F.count("_n").alias("tiles_with_lines"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("segments"), F.coalesce(F.max("_n"), F.lit(0)).alias("max_segments"))


def verify_tree(tiles: DataFrame) -> DataFrame:
    """Violations (KEY, problem): a tile without its parent, a parent with some but not all
    children, a duplicate, a path longer than its level."""
    up = tiles.where(F.col("level") > 0).select(
        "patch", (F.col("level") - 1).cast("int").alias("level"), keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("path"))
    kids = up.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_kids"))
    have = tiles.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_copies"))
    j = have.join(kids, KEY, "full")
    problem = (
        F.when(F.col("_copies").isNull(), "missing parent").when(F.col("_copies") > 1, "duplicate")
        .when(F.col("_kids") < 4, "missing children").when(F.col("path") > keys.low_mask(F.col("level")), "bad path"))
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*KEY, "problem")


def verify_coverage(bridge: DataFrame, segs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Violations (line_id, seg, KEY, problem): unknown segment, duplicate row, no real
    intersection, or a row of a removed segment."""
    ids = ["line_id", "seg"]
    b = bridge.select(*ids, *KEY)
    unknown = b.join(segs.select(*ids), ids, "left_anti").withColumn("problem", F.lit("unknown segment"))
    twice = b.groupBy(*ids, *KEY).count().where("count > 1").drop("count").withColumn("problem", F.lit("duplicate"))
    framed = with_side_sections(with_scope(b.select(*KEY).distinct())).drop(*SCOPE_NAMES)
    apart = (
        b.join(segs, ids).join(framed, KEY).where(~segment_intersects(V3.of("a"), V3.of("b")))
        .select(*ids, *KEY).distinct().withColumn("problem", F.lit("no intersection")))
    out = unknown.unionByName(twice).unionByName(apart)
    if removed is not None:
        out = out.unionByName(b.join(removed.select(*ids), ids, "left_semi").withColumn("problem", F.lit("removed segment")))
    return out
