"""Which cells do images, segments and layers touch: level-by-level descents and key joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.functions import keys
from terrasphere.functions.descent import SCOPE_NAMES, box_descend, segment_descend, with_rings, with_scope
from terrasphere.functions.vec import V3
from terrasphere.operators.coverage import crossing, edge_extent, edges_cross, given_rings, image_ring, meet_in_cells, odd_crossings, ring_edges
from terrasphere.operators.grid import segment_intersects, with_side_sections
from terrasphere.operators.pyramid import level_asof
from terrasphere.session import cut_lineage

KEY = ["patch", "level", "path"]


def scope_footprint(cells: DataFrame, subdivisions: int = 3) -> DataFrame:
    """Add ring: the boundary of each cell as an unwrapped lon/lat ring of 4 * 2^k vertices
    (more where it holds a pole)."""
    return with_rings(cells, subdivisions)


def image_tile_join(images: DataFrame, level, subdivisions: int = 3, stride: int = 3, coverage: DataFrame | None = None) -> DataFrame:
    """(image_id, patch, level, path) of the tiles an image touches at its level.

    The frontier carries the image's box, so a descent is narrow: no join, never images
    times tiles. After every stride levels it is spread by (image, path), because one large
    image may hold most of it, and checkpointed. What the boxes leave is decided exactly by
    the rings of image and tile. Images with given coverage polygons (image_id, ord, x, y in
    pixels) count where these lie.
    """
    lv = level if isinstance(level, Column) else F.lit(level)
    start = images.withColumn("want", lv.cast("int"))
    whole = start if coverage is None else start.join(coverage.select("image_id").distinct(), "image_id", "left_anti")
    ring = whole.select("image_id", F.posexplode(image_ring(subdivisions)).alias("ord", "v")).select(
        "image_id", F.col("ord").cast("bigint").alias("ord"), F.col("v.lon").alias("x"), F.col("v.lat").alias("y"))
    if coverage is not None:
        ring = ring.unionByName(given_rings(images, coverage))
    ring = cut_lineage(ring)
    box = ring.groupBy("image_id").agg(F.min("x").alias("min_lon"), F.min("y").alias("min_lat"), F.max("x").alias("max_lon"), F.max("y").alias("max_lat"))
    frontier = start.select("image_id", "want").join(box.hint("merge"), "image_id").select("image_id", "want", "min_lon", "min_lat", "max_lon", "max_lat")
    # boxes are small rows of long descents: they are dealt by number, not by size
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frontier = frontier.repartition(parts, "image_id")
    top = images.agg(F.max(lv)).first()[0]
    done, first = None, 0
    while first <= (top or 0):
        last = min(first + stride, top or 0)
        reached = box_descend(frontier, ["image_id"], first, last, subdivisions)
        if last < (top or 0):
            reached = cut_lineage(reached.repartition(parts, "image_id", "path"))
        arrived = reached.where(F.col("level") == F.col("want")).select("image_id", *KEY)
        done = arrived if done is None else done.unionByName(arrived)
        frontier = reached.where(F.col("level") < F.col("want"))
        first = last + 1
    return rings_meet(cut_lineage(done), ring, subdivisions)


def rings_meet(pairs: DataFrame, image_vertices: DataFrame, subdivisions: int) -> DataFrame:
    """The pairs (image_id, KEY) whose rings cross, or of which one holds the other; roots always count.

    image_vertices: (image_id, ord, x, y), rings of any length. A tile meets only the edges of its image that share a cell
    with it, and for the test whether the image holds it only those at the height of its first vertex. Both sides of every join
    grow with the images, and Spark takes exploded rings for the few rows they come from, so the joins are told to merge.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = with_rings(pairs.where("level > 0").select(*KEY).repartition(parts, *KEY).distinct(), subdivisions)
    tile = F.struct(*KEY).alias("tile")
    flat = tiles.select(tile, F.posexplode("ring").alias("ord", "v")).select("tile", "ord", F.col("v.lon").alias("x"), F.col("v.lat").alias("y"))
    tile_edges = cut_lineage(ring_edges(flat, "tile"))
    image_edges = cut_lineage(ring_edges(image_vertices, "image_id"))
    box = tile_edges.groupBy("tile").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                                         F.min_by("x", "ord").alias("tx"), F.min_by("y", "ord").alias("ty"))
    image = image_edges.groupBy("image_id").agg(F.min("x").alias("i0"), F.max("x").alias("i1"), F.min("y").alias("j0"), F.max("y").alias("j1"),
                                                F.min_by("x", "ord").alias("ix"), F.min_by("y", "ord").alias("iy"))
    turn = F.explode(F.array(F.lit(0.0), F.lit(2 * math.pi), F.lit(-2 * math.pi))).alias("turn")
    cand = pairs.where("level > 0").select("image_id", tile, turn).join(box.hint("merge"), "tile").join(image.hint("merge"), "image_id")
    cand = cand.withColumns({c: F.col(c) + F.col("turn") for c in ("x0", "x1", "tx")})
    cand = cut_lineage(cand.where("x0 <= i1 AND x1 >= i0 AND y0 <= j1 AND y1 >= j0").drop("i0", "i1", "j0", "j1"))
    tile_box = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    met = meet_in_cells(cand.drop("tx", "ty", "ix", "iy"), image_edges, tile_box, edge_extent("x", "y", "x2", "y2"), ("image_id",))
    over = (F.least("x", "x2") <= F.col("x1")) & (F.greatest("x", "x2") >= F.col("x0")) & (F.least("y", "y2") <= F.col("y1")) & (F.greatest("y", "y2") >= F.col("y0"))
    own = tile_edges.select("tile", *[F.col(a).alias(b) for a, b in (("x", "u"), ("y", "v"), ("x2", "u2"), ("y2", "v2"))])
    crossed = met.where(over).join(own.hint("merge"), "tile").withColumns({"u": F.col("u") + F.col("turn"), "u2": F.col("u2") + F.col("turn")}).where(edges_cross())
    crossed = crossed.select("image_id", "tile")
    # without a crossing, one first vertex tells whether the other ring holds it
    within = odd_crossings(cand.select("image_id", "tile", "turn", F.col("tx").alias("px"), F.col("ty").alias("py")), image_edges, ["tile", "turn"], "image_id")
    around = cand.select("image_id", "tile", "turn", "ix", "iy").join(tile_edges.hint("merge"), "tile").groupBy("image_id", "tile", "turn").agg(
        (F.sum(crossing(F.col("ix") - F.col("turn"), F.col("iy"))) % 2).alias("odd"))
    held = within.select("image_id", "tile").unionByName(around.where("odd = 1").select("image_id", "tile"))
    found = crossed.unionByName(held).distinct().select("image_id", "tile.*")
    return found.unionByName(pairs.where("level = 0").select("image_id", *KEY))


def segment_cell_join(segs: DataFrame, max_level: int, existing: DataFrame | None = None, seg_keys: list[str] | None = None) -> DataFrame:
    """(segment keys, patch, level, path, is_leaf) of all cells a segment (a*, b* vectors) crosses.

    With existing cells the descent stops where the tree stops: each step is a narrow
    kernel followed by a semi join on the cell key.
    """
    seg_keys = seg_keys or ["line_id", "seg"]
    vec = [f"{p}{a}" for p in "ab" for a in "xyz"]
    if existing is None:
        out = segment_descend(segs.select(*seg_keys, *vec), seg_keys, 0, max_level)
        return out.withColumn("is_leaf", F.col("level") == max_level).select(*seg_keys, *KEY, "is_leaf")
    have = cut_lineage(existing.select(*KEY).distinct())
    parents = have.where(F.col("level") > 0).select(
        "patch", (F.col("level") - 1).cast("int").alias("level"),
        keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("path")).distinct().withColumn("_inner", F.lit(True))
    # every level is read by the next one and, maybe often, by the result
    frontier = cut_lineage(segment_descend(segs.select(*seg_keys, *vec), seg_keys, 0, 0).join(have, KEY, "left_semi"))
    found = frontier
    for level in range(1, max_level + 1):
        frontier = segment_descend(frontier, seg_keys, level, level).join(have.where(F.col("level") == level), KEY, "left_semi")
        frontier = cut_lineage(frontier)
        found = found.unionByName(frontier)
    flagged = found.join(parents, KEY, "left")
    return flagged.select(*seg_keys, *KEY, F.col("_inner").isNull().alias("is_leaf"))


def inherit(parent_cov: DataFrame, children: DataFrame, segs: DataFrame, seg_keys: list[str]) -> DataFrame:
    """Coverage of child cells from their parent's segments that cross them."""
    kids = children.where(F.col("level") > 0).select(
        *KEY, (F.col("level") - 1).cast("int").alias("_pl"), keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("_pp"))
    up = parent_cov.select(*seg_keys, F.col("patch"), F.col("level").alias("_pl"), F.col("path").alias("_pp"))
    framed = with_side_sections(with_scope(kids)).drop(*SCOPE_NAMES)
    cand = up.join(framed, ["patch", "_pl", "_pp"]).join(segs, seg_keys)
    return cand.where(segment_intersects(V3.of("a"), V3.of("b"))).select(*seg_keys, *KEY)


def add_coverage(bridge: DataFrame, new: DataFrame, seg_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bridge with new rows, cells that became stale)."""
    cols = [*seg_keys, *KEY]
    out = bridge.select(*cols).unionByName(new.select(*cols)).dropDuplicates(cols)
    stale = new.join(bridge, cols, "left_anti").select(*KEY).distinct()
    return out, stale


def remove_coverage(bridge: DataFrame, gone: DataFrame, seg_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bridge without the gone segments, cells that became stale)."""
    ids = gone.select(*seg_keys).distinct()
    return bridge.join(ids, seg_keys, "left_anti"), bridge.join(ids, seg_keys, "left_semi").select(*KEY).distinct()


def cells_with_children(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells below which any layer holds a tile one level down."""
    parents = tiles.where(F.col("level") > 0).select(
        "patch", (F.col("level") - 1).cast("int").alias("level"),
        keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("path"))
    return cells.join(parents, KEY, "left_semi")


def multi_layer_join(cells: DataFrame, tiles: DataFrame, layers: list[int], value: str, default=None) -> DataFrame:
    """One column per layer with the value of the cell's own tile or its nearest ancestor's.

    The levels in use are joined finest first, with the (cell, layer) rows still open.
    """
    kind = tiles.schema["layer_id"].dataType
    asked = cells.select(*KEY).distinct().withColumn("layer_id", F.explode(F.array(*[F.lit(k).cast(kind) for k in layers])))
    found = level_asof(asked, tiles.select(*KEY, "layer_id", F.col(value).alias("_value")), ["layer_id"], ("layer_id",))
    named = found.groupBy(*KEY).agg(*[F.max(F.when(F.col("layer_id") == k, F.col("_value"))).alias(f"layer_{k}") for k in layers])
    out = cells.select(*KEY).join(named, KEY, "left")
    if default is not None:
        out = out.fillna(default, [f"layer_{k}" for k in layers])
    return out
