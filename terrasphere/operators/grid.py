"""Cells of the global grid: lookup, hierarchy, geometry and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS, MAX_LEVEL
from terrasphere.functions import keys
from terrasphere.functions.descent import SCOPE_NAMES, cell_of, patch_of
from terrasphere.functions.hits import Section, ray_section
from terrasphere.functions.patches import SIDES, base_neighbors, resolution_at
from terrasphere.functions.vec import V3, names, num, put
from terrasphere.session import cut_lineage


def with_patch(points: DataFrame, p: V3) -> DataFrame:
    return points.withColumn("patch", patch_of(p))


def with_cell(points: DataFrame, p: V3, level) -> DataFrame:
    """Add patch, level and path of the cell holding p: narrow, no shuffle."""
    df = points.withColumn("level", (level if isinstance(level, Column) else F.lit(level)).cast("int"))
    df = df.withColumn("_cell", cell_of(p, F.col("level")))
    return df.withColumns({"patch": F.col("_cell.patch"), "path": F.col("_cell.path")}).drop("_cell")


def with_tile(cells: DataFrame) -> DataFrame:
    tx, ty = keys.tile_xy(F.col("level"), F.col("path"))
    return cells.withColumns({"tx": tx, "ty": ty})


def ancestors(cells: DataFrame) -> DataFrame:
    """One row per ancestor and the cell itself: level, path are replaced, leaf_level, leaf_path kept."""
    return (
        cells.withColumnsRenamed({"level": "leaf_level", "path": "leaf_path"})
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf_level"))))
        .withColumn("path", keys.ancestor_path(F.col("leaf_path"), F.col("level")))
    )


def proper_ancestors(cells: DataFrame) -> DataFrame:
    return ancestors(cells).where(F.col("level") < F.col("leaf_level"))


def split(cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Four children of every cell that carries corners c0x..c3z.

    Children sharing a side get bitwise equal corners because the midpoints are
    sums of the same two operands.
    """
    c = [V3.of(f"c{i}") for i in range(4)]
    keep = [k for k in (keep or cells.columns) if k not in ("level", "path", *SCOPE_NAMES)]
    df = put(
        cells,
        mt=(c[3] + c[2]).unit(), ml=(c[2] + c[0]).unit(), mb=(c[0] + c[1]).unit(), mr=(c[1] + c[3]).unit(),
    )
    df = put(df, mm=(V3.of("mt") + V3.of("mb")).unit())
    top, left, bottom, right, mid = (V3.of(n) for n in ("mt", "ml", "mb", "mr", "mm"))
    kids = [
        (c[0], bottom, left, mid),
        (bottom, c[1], mid, right),
        (left, mid, c[2], top),
        (mid, right, top, c[3]),
    ]
    structs = []
    for which, corners in enumerate(kids):
        level, path = keys.child(F.col("level"), F.col("path"), F.lit(which))
        cols = [x for i, v in enumerate(corners) for x in v.cols(f"c{i}")]
        structs.append(F.struct(F.lit(which).alias("child"), level.alias("level"), path.alias("path"), *cols))
    return df.select(*keep, F.inline(F.array(*structs)))


def centroid(radius=1.0) -> V3:
    c = [V3.of(f"c{i}") for i in range(4)]
    return (c[0] + c[1] + c[2] + c[3]).unit() * num(radius)


def scope_radius() -> Column:
    return V3.of("c0").norm()


def resolution(n: int = 65, radius=EARTH_RADIUS) -> Column:
    """Sample spacing of a cell at its first corner along the lower side, in metres."""
    a, b = V3.of("c0").unit(), V3.of("c1").unit()
    half_chord = a.dist(b) * 0.5
    return num(radius) * F.asin(F.least(half_chord, F.lit(1.0))) * 2.0 / F.lit(float(n - 1))


def level_table(spark: SparkSession, n: int = 65, radius: float = EARTH_RADIUS) -> DataFrame:
    rows = [(lv, resolution_at(lv, n, radius)) for lv in range(MAX_LEVEL + 1)]
    return spark.createDataFrame(rows, "level int, resolution double")


def level_for(image_resolution: Column, n: int = 65, radius: float = EARTH_RADIUS) -> Column:
    """Coarsest level whose spacing is at most sqrt(2) x the image's (24-way lookup)."""
    limit = image_resolution * F.sqrt(F.lit(2.0))
    expr = F.when(limit >= resolution_at(0, n, radius), 0)
    for lv in range(1, MAX_LEVEL + 1):
        expr = expr.when(limit >= resolution_at(lv, n, radius), lv)
    return expr.otherwise(MAX_LEVEL)


def with_side_sections(cells: DataFrame) -> DataFrame:
    """Add the four side sections s0.. to s3.. (top, left, bottom, right) of corners c0x..c3z."""
    vectors = {}
    for k, (i, j) in enumerate(SIDES):
        vectors.update(Section.between(V3.of(f"c{i}"), V3.of(f"c{j}")).vectors(f"s{k}"))
    return put(cells, **vectors)


SIDE_SECTION_NAMES = [n for k in range(4) for n in names(f"s{k}n", f"s{k}a", f"s{k}b")]


def segment_intersects(a: V3, b: V3) -> Column:
    """Does the segment a..b cross the cell with side sections s0..s3?

    Entry and exit over the four bounded sections must overlap [0, 1].
    """
    hits = [ray_section(a, b - a, Section.of(f"s{k}")) for k in range(4)]
    return F.coalesce((F.greatest(*hits) >= 0) & (F.least(*hits) <= 1), F.lit(False))


def bounding_sphere(cells: DataFrame, vertical_scale=1.0, radius=EARTH_RADIUS, default_height=0.0) -> DataFrame:
    """Add bx, by, bz, br from corners and min_elev, max_elev (either NULL: default height)."""
    missing = F.col("min_elev").isNull() | F.col("max_elev").isNull()
    lo = F.when(missing, F.lit(float(default_height))).otherwise(F.col("min_elev"))
    hi = F.when(missing, F.lit(float(default_height))).otherwise(F.col("max_elev"))
    vs = num(vertical_scale)
    df = put(cells.withColumns({"_lo": lo, "_hi": hi}),
             b=centroid(num(radius) + (F.col("_lo") + F.col("_hi")) * 0.5 * vs))
    reach = [
        (V3.of(f"c{i}").unit() * (num(radius) + F.col(h) * vs)).dist(V3.of("b"))
        for i in range(4) for h in ("_lo", "_hi")
    ]
    return df.withColumn("br", F.greatest(*reach)).drop("_lo", "_hi")


def kin(cells: DataFrame, dx, dy, crossings: int = 2) -> DataFrame:
    """Cell at a tile offset on the same level: kin_patch, kin_tx, kin_ty, kin_path, orientation.

    Leaving the patch crosses a shared side into the neighbour's frame; a diagonal
    step crosses the side with the larger excess first, then the other. A step of any length takes as many
    crossings as it passes sides; where that is more than crossings, the kin is NULL.
    """
    df = with_tile(cells) if "tx" not in cells.columns else cells
    df = df.withColumns({
        "kin_patch": F.col("patch"), "orientation": F.lit(0),
        "kin_tx": F.col("tx") + dx, "kin_ty": F.col("ty") + dy,
        "_n": keys.shl(F.lit(1), F.col("level")),
    })
    sides = F.broadcast(base_neighbors(cells.sparkSession))  # 120 rows, fixed
    for _ in range(crossings):
        df = _cross(df, sides)
    there = F.col("kin_tx").between(0, F.col("_n") - 1) & F.col("kin_ty").between(0, F.col("_n") - 1)
    df = df.withColumn("_in", there).withColumns({c: F.when(F.col("_in"), F.col(c)) for c in ("kin_patch", "kin_tx", "kin_ty", "orientation")}).drop("_in")
    df = df.withColumn("kin_path", keys.path_of_tile(F.col("level"), F.col("kin_tx"), F.col("kin_ty")))
    return df.drop("_n")


def _cross(df: DataFrame, sides: DataFrame) -> DataFrame:
    x, y, n = F.col("kin_tx"), F.col("kin_ty"), F.col("_n")
    ex = F.when(x < 0, -x).when(x >= n, x - n + 1).otherwise(0)
    ey = F.when(y < 0, -y).when(y >= n, y - n + 1).otherwise(0)
    side = (
        F.when((ex == 0) & (ey == 0), -1)
        .when(ex > ey, F.when(x < 0, 1).otherwise(3))
        .otherwise(F.when(y < 0, 2).otherwise(0))
    )
    along = F.when(side == 0, n - 1 - x).when(side == 1, n - 1 - y).when(side == 2, x).otherwise(y)
    depth = F.when(side == 0, y - n).when(side == 1, -1 - x).when(side == 2, -1 - y).otherwise(x - n)
    df = df.withColumns({"_side": side, "_a": n - 1 - along, "_d": depth})
    s = sides.select(
        F.col("patch").alias("_p"), F.col("side").alias("_s"), F.col("neighbor").alias("_q"),
        F.col("orientation").alias("_o"), F.col("neighbor_side").alias("_t"),
    )
    df = df.join(s, (df["kin_patch"] == s["_p"]) & (df["_side"] == s["_s"]), "left")
    a, d, t = F.col("_a"), F.col("_d"), F.col("_t")
    nx = F.when(t == 0, n - 1 - a).when(t == 1, d).when(t == 2, a).otherwise(n - 1 - d)
    ny = F.when(t == 0, n - 1 - d).when(t == 1, n - 1 - a).when(t == 2, d).otherwise(a)
    crossed = F.col("_q").isNotNull()
    return df.withColumns({
        "kin_tx": F.when(crossed, nx).otherwise(x),
        "kin_ty": F.when(crossed, ny).otherwise(y),
        "kin_patch": F.coalesce("_q", "kin_patch"),
        "orientation": (F.col("orientation") + F.coalesce("_o", F.lit(0))) % 4,
    }).drop("_side", "_a", "_d", "_p", "_s", "_q", "_o", "_t")


def deepest_existing(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Deepest existing cell at or above each wanted (key, patch, level, path), with the offset
    of the wanted cell inside it in wanted-level tiles (off_x, off_y)."""
    have = cut_lineage(existing.select("patch", "level", "path").distinct())
    rest = wanted.select(key, "patch", F.col("level").alias("leaf_level"), F.col("path").alias("leaf_path"))
    found = None
    # finest level first, each with the cells still open
    for level in sorted((r[0] for r in have.select("level").distinct().collect()), reverse=True):  # at most 24
        here = have.where(F.col("level") == level).select("patch", F.col("path").alias("_at"), F.lit(True).alias("_hit"))
        at = F.when(F.col("leaf_level") >= level, keys.ancestor_path(F.col("leaf_path"), F.lit(level)))
        met = cut_lineage(rest.withColumn("_at", at).join(here, ["patch", "_at"], "left"))
        part = met.where("_hit").select(key, F.lit(level).alias("level"), F.col("_at").alias("path"), "patch", "leaf_level", "leaf_path")
        found = part if found is None else found.unionByName(part)
        rest = met.where("_hit IS NULL").drop("_at", "_hit")
    if found is None:
        found = wanted.where(F.lit(False)).select(key, "level", "path", "patch", F.col("level").alias("leaf_level"), F.col("path").alias("leaf_path"))
    below = F.col("leaf_level") - F.col("level")
    rest = keys.shr(F.col("leaf_path"), (F.col("level") * 2).cast("int"))
    ox, oy = keys.tile_xy(below, rest)
    return found.withColumns({"off_x": ox, "off_y": oy})
