"""Multiresolution pyramid over lattice vertices (patch, level, gx, gy, value).

Shared tile edges are one vertex. NULL or absent means nodata. Kernels scatter each
vertex to the vertices it feeds and aggregate: small ones by rows, so partial aggregation
runs before the shuffle, wide ones and upsampling within blocks. No neighbour join or window
is needed. As in the source system, a kernel never reaches across a base patch side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.functions import keys
from terrasphere.operators.grid import ancestors
from terrasphere.operators.raster import to_byte
from terrasphere.session import cut_lineage

# The 21-tap kernel, symmetric about its middle entry.
LANCZOS5 = (
    7.60213661720011e-34, 0.00386785330198227, -4.5610817871754e-18, -0.0167391813072476, 9.83998047615722e-18,
    0.0405539013275657, -1.47599707142358e-17, -0.0911355426727928, 1.82443271487016e-17, 0.313296117460564,
    0.500313703779858, 0.313296117460564, 1.82443271487016e-17, -0.0911355426727928, -1.47599707142358e-17,
    0.0405539013275657, 9.83998047615722e-18, -0.0167391813072476, -4.5610817871754e-18, 0.00386785330198227,
    7.60213661720011e-34,
)
TENT = (0.25, 0.5, 0.25)
SPAN = 64  # vertices along a side of the blocks that wide kernels and upsampling make at once
TOGETHER = 32  # blocks that are made in one step
NO_PATCH = -(2**31)


def side(level: Column, n: int) -> Column:
    """Highest lattice coordinate of a level."""
    return keys.shl(F.lit(n - 1), level)


def _scatter(c: str, kernel: tuple[float, ...]) -> Column:
    """array<struct<p, w>> of the coarse coordinates that fine coordinate c feeds.

    Only taps of the parity of c land on a coarse vertex; bounds are checked after the explode.
    """
    r = len(kernel) // 2
    g = F.col(c).cast("bigint")
    def taps(parity: int) -> Column:
        return F.array(*[
            F.struct(F.call_function("shiftright", g - d, F.lit(1)).alias("p"), F.lit(kernel[d + r]).alias("w"))
            for d in range(-r, r + 1) if d % 2 == parity])
    return F.when(g % 2 == 0, taps(0)).otherwise(taps(1))


def kernel_weights(kernel) -> tuple[float, ...]:
    """Separable weights of a kernel given by name or as 2r+1 numbers; 'point' has one tap."""
    named = {"tent": TENT, "lanczos5": LANCZOS5, "point": (1.0,)}
    return named[kernel] if isinstance(kernel, str) else tuple(kernel)


def fed_vertices(changed: DataFrame, n: int, kernel="tent") -> DataFrame:
    """Vertices (patch, level, gx, gy) of the next coarser level that changed ones feed, each once."""
    weights = kernel_weights(kernel)
    up = changed.where(F.col("level") > 0).select("patch", (F.col("level") - 1).cast("int").alias("level"), _scatter("gx", weights).alias("_x"), _scatter("gy", weights).alias("_y"))
    flat = up.select("patch", "level", F.explode("_x.p").alias("gx"), "_y").distinct().select("patch", "level", "gx", F.explode("_y.p").alias("gy"))
    top = side(F.col("level"), n)
    return flat.where(F.col("gx").between(0, top) & F.col("gy").between(0, top)).distinct()


def downsample(fine: DataFrame, n: int, kernel="tent", with_weight: bool = False, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Next coarser level. kernel: 'tent', 'lanczos5', 'point' or 2r+1 separable weights.

    values are the columns of a vertex (three for colours); it is nodata where the first is
    NULL. with_weight adds the weighted sum (numerator) of the first and the total weight
    of the valid taps.
    """
    valid = fine.where(F.col(values[0]).isNotNull() & (F.col("level") > 0))
    up = (F.col("level") - 1).cast("int")
    if kernel == "point":
        even = valid.where((F.col("gx") % 2 == 0) & (F.col("gy") % 2 == 0))
        return even.select("patch", up.alias("level"), keys.shr(F.col("gx"), 1).alias("gx"), keys.shr(F.col("gy"), 1).alias("gy"), *values)
    weights = kernel_weights(kernel)
    if len(weights) <= 3:
        top = side(F.col("level"), n)
        src = valid.withColumns({"level": up, "_xs": _scatter("gx", weights), "_ys": _scatter("gy", weights)})
        flat = src.select("patch", "level", F.explode("_xs").alias("x"), "_ys", *values).where(F.col("x.p").between(0, top)).select(
            "patch", "level", "x", F.explode("_ys").alias("y"), *values).where(F.col("y.p").between(0, top))
        w = F.col("x.w") * F.col("y.w")
        sums = flat.groupBy("patch", "level", F.col("x.p").alias("gx"), F.col("y.p").alias("gy")).agg(
            *[F.sum(w * F.col(v)).alias("_s" + v) for v in values], F.sum(w).alias("weight"))
    else:
        src = valid.select("patch", up.alias("level"), "gx", "gy", *values)
        sums = in_blocks(src, n, weights, values).withColumnRenamed("_w", "weight")
    out = ["patch", "level", "gx", "gy", *[(F.col("_s" + v) / F.col("weight")).alias(v) for v in values]]
    return sums.where(F.col("weight") != 0).select(*out, *([F.col("_s" + values[0]).alias("numerator"), "weight"] if with_weight else []))


def downsample_rgb(fine: DataFrame, n: int, kernel="tent", bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Next coarser level of a colour pyramid: every band clamped to 0..255 and rounded half up."""
    out = downsample(fine, n, kernel, values=bands)
    return out.withColumns({b: to_byte(F.col(b)) for b in bands})


def upsample(coarse: DataFrame, n: int, cells: DataFrame | None = None) -> DataFrame:
    """Next finer level: even vertices copy, odd ones average their two or four neighbours.

    With cells (patch, level, path) of the coarse level, only their children are made.
    """
    valid = coarse.where(F.col("value").isNotNull())
    src = valid.select("patch", (F.col("level") + 1).cast("int").alias("level"), "gx", "gy", "value")
    fine = in_blocks(src, n, None, ("value",)).select("patch", "level", "gx", "gy", (F.col("_svalue") / F.col("_w")).alias("value"))
    if cells is None:
        return fine
    four = cells.select("patch", "level", "path", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("_k"))
    level, path = keys.child(F.col("level"), F.col("path"), F.col("_k"))
    kids = four.select("patch", level.cast("int").alias("level"), path.alias("path"))
    return restrict(fine, kids, n, once=False)


def in_blocks(src: DataFrame, n: int, kernel: tuple[float, ...] | None, values: tuple[str, ...]) -> DataFrame:
    """Weighted sums _s<value> and weight _w of the vertices (patch, level, gx, gy) of a level that others feed.

    src carries the level that is made and places on the level below it (with a kernel) or above it (without one: a vertex
    copies and its neighbours take the mean). A vertex goes to the blocks of made vertices it feeds, mostly one; a block is summed where it lies, one axis
    at a time, so what a kernel spreads is neither shuffled nor kept in a table of groups.
    """
    reach = 1 if kernel is None else len(kernel) // 2
    key = ["patch", "level", "bx", "by"]
    top = side(F.col("level"), n)
    rows = src.where("gx IS NOT NULL AND gy IS NOT NULL AND level IS NOT NULL").select(
        F.coalesce(F.col("patch").cast("int"), F.lit(NO_PATCH)).alias("patch"), F.col("level").cast("int").alias("level"),
        F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), *[F.col(v).cast("double").alias(v) for v in values])
    for c, b in (("gx", "bx"), ("gy", "by")):
        g = F.col(c)
        lo, hi = (g * 2 - 1, g * 2 + 1) if kernel is None else (F.ceil((g - reach) / 2), F.floor((g + reach) / 2))
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, top)
        rows = rows.where(lo <= hi).withColumn(b, F.explode(F.sequence(F.floor(lo / SPAN).cast("bigint"), F.floor(hi / SPAN).cast("bigint"))))
    # dealt by number, not by size: what a task sorts grows no faster than the input
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key)
    names = [f"_s{v}" for v in values]

    def sums(x, y, blk, bx, by, ends, value, nb, weights):
        """(blocks, rows, columns) of made vertices: what `value` of the given vertices adds to them."""
        import numpy as np

        own, first = bx[blk] * SPAN, (by[blk] * SPAN // 2 if kernel is None else by[blk] * (2 * SPAN) - reach)
        height = SPAN // 2 + 1 if kernel is None else 2 * SPAN + 2 * reach
        spot, part = [], []
        for d in range(-reach, reach + 1):
            to = 2 * x + d if kernel is None else (x - d) >> 1
            ok = (to >= own) & (to < own + SPAN) & (to <= ends[blk]) & (y >= first) & (y < first + height)
            if kernel is not None:
                ok &= (x - d) % 2 == 0
            spot.append(((blk * height + y - first) * SPAN + to - own)[ok])
            part.append(value[ok] if kernel is None else value[ok] * weights[d + reach])
        flat = np.bincount(np.concatenate(spot), np.concatenate(part), nb * height * SPAN).reshape(nb, height, SPAN)
        made = np.zeros((nb, SPAN, SPAN))
        if kernel is None:
            made[:, 0::2], made[:, 1::2] = flat[:, :-1], flat[:, :-1] + flat[:, 1:]
        else:
            for k, w in enumerate(weights):
                made += w * flat[:, k : k + 2 * SPAN : 2]
        return made

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        def emit(ids, arrays):
            weight, ends = arrays[0], (n - 1) << ids[1]
            at = np.arange(SPAN)
            ok = (weight != 0) & (ids[3][:, None] * SPAN + at <= ends[:, None])[:, :, None]
            blk, y, x = np.nonzero(ok)
            patch = ids[0][blk]
            cols = [pa.array(patch.astype(np.int32), mask=patch == NO_PATCH), pa.array(ids[1][blk].astype(np.int32)),
                    pa.array(ids[2][blk] * SPAN + x), pa.array(ids[3][blk] * SPAN + y)]
            cols += [pa.array(s[ok], mask=c[ok] == 0) for s, c in zip(arrays[1::2], arrays[2::2])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(weight[ok])], ["patch", "level", "gx", "gy", *names, "_w"])

        last, held = None, None  # the block that may go on, and its sums
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            edge = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1]
            x, y = (batch.column(c).to_numpy() for c in ("gx", "gy"))
            there = [batch.column(v).is_valid().to_numpy(zero_copy_only=False) for v in values]
            value = [batch.column(v).fill_null(0.0).to_numpy() for v in values]
            for some in range(0, len(edge), TOGETHER):
                starts = edge[some : some + TOGETHER]
                to = edge[some + TOGETHER] if some + TOGETHER < len(edge) else batch.num_rows
                cut, mine, nb = slice(starts[0], to), ids[:, starts], len(starts)
                blk = np.repeat(np.arange(nb), np.diff(np.r_[starts, to]))
                add = lambda v, w=kernel: sums(x[cut], y[cut], blk, mine[2], mine[3], (n - 1) << mine[1], v, nb, w)
                arrays = [add(np.ones(to - starts[0]))]
                for v, t in zip(value, there):
                    # a value that is missing in every vertex that feeds another is missing there
                    arrays += [add(v[cut]), np.ones((nb, SPAN, SPAN)) if t[cut].all() else add(t[cut].astype(float), [1.0] * (2 * reach + 1))]
                if last is not None:
                    if (mine[:, 0] == last[:, 0]).all():
                        for a, h in zip(arrays, held):
                            a[0] += h[0]
                    else:
                        yield emit(last, held)
                if nb > 1:
                    yield emit(mine[:, :-1], [a[:-1] for a in arrays])
                last, held = mine[:, -1:], [a[-1:] for a in arrays]
        if last is not None:
            yield emit(last, held)

    fields = ", ".join(f"{c} double" for c in [*names, "_w"])
    return dealt.mapInArrow(scan, f"patch int, level int, gx bigint, gy bigint, {fields}")


def vertex_tiles(lattice: DataFrame, n: int) -> DataFrame:
    """One row per (vertex, tile): a vertex on a shared edge belongs to up to four tiles."""
    size = F.lit(n - 1)
    last = keys.shl(F.lit(1), F.col("level")) - 1
    def tiles(c):
        t = F.floor(F.col(c) / size).cast("bigint")
        options = F.array(F.when(t <= last, t), F.when((F.col(c) % size == 0) & (t > 0), t - 1))
        return F.array_compact(options)
    return lattice.withColumn("tx", F.explode(tiles("gx"))).withColumn("ty", F.explode(tiles("gy")))


def tiles_of(lattice: DataFrame, n: int) -> DataFrame:
    t = vertex_tiles(lattice, n)
    return t.select("patch", "level", keys.path_of_tile(F.col("level"), F.col("tx"), F.col("ty")).alias("path")).distinct()


def restrict(lattice: DataFrame, cells: DataFrame, n: int, once: bool = True) -> DataFrame:
    """Vertices that belong to at least one of the given cells (patch, level, path); each once, unless they are known to be.

    A vertex meets the tile to its upper right alone: that tile knows which of the tiles that share its
    left side, its lower side and its corner are wanted.
    """
    tx, ty = keys.tile_xy(F.col("level"), F.col("path"))
    shares = F.array(*[F.struct((tx + i).alias("tx"), (ty + j).alias("ty"), F.lit(1 << (i + 2 * j)).alias("_m")) for j in (0, 1) for i in (0, 1)])
    wanted = cells.select("patch", "level", F.inline(shares)).groupBy("patch", "level", "tx", "ty").agg(F.bit_or("_m").alias("_m"))
    size = F.lit(n - 1)
    near = lattice.withColumns({"tx": F.floor(F.col("gx") / size).cast("bigint"), "ty": F.floor(F.col("gy") / size).cast("bigint")})
    left, low = F.col("gx") % size == 0, F.col("gy") % size == 0
    shared = F.lit(1) + F.when(left, 2).otherwise(0) + F.when(low, 4).otherwise(0) + F.when(left & low, 8).otherwise(0)
    hit = near.join(wanted.hint("merge"), ["patch", "level", "tx", "ty"]).where(F.col("_m").bitwiseAND(shared) != 0).select(*lattice.columns)
    return hit.dropDuplicates(["patch", "level", "gx", "gy"]) if once else hit


def refine_missing(lattice: DataFrame, needed: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """Vertices of needed cells that do not exist yet, upsampled from their parents."""
    missing = needed.join(existing, ["patch", "level", "path"], "left_anti").where(F.col("level") > 0)
    up = missing.select("patch", (F.col("level") - 1).cast("int").alias("level"),
                        keys.ancestor_path(F.col("path"), F.col("level") - 1).alias("path")).distinct()
    made = upsample(restrict(lattice, up, n), n)
    return restrict(made, missing, n, once=False)


def dirty_ancestors(changed: DataFrame) -> DataFrame:
    """All proper ancestors of changed cells, each once."""
    base = changed.select("patch", "level", "path").distinct()
    up = ancestors(base).where(F.col("level") < F.col("leaf_level"))
    return up.select("patch", "level", "path").distinct()


def tile_ranges(lattice: DataFrame, n: int) -> DataFrame:
    """Value range per tile of its own vertices."""
    t = vertex_tiles(lattice.where(F.col("value").isNotNull()), n)
    return t.groupBy("patch", "level", "tx", "ty").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value")).select(
        "patch", "level", keys.path_of_tile(F.col("level"), F.col("tx"), F.col("ty")).alias("path"), "min_value", "max_value")


def tile_stats(lattice: DataFrame, n: int) -> DataFrame:
    """Value range per tile including all its descendants (any mix of levels)."""
    up = ancestors(tile_ranges(lattice, n))
    return up.groupBy("patch", "level", "path").agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def global_range(lattice: DataFrame, default: float = 0.0) -> DataFrame:
    return lattice.agg(
        F.coalesce(F.min("value"), F.lit(default)).alias("min_value"),
        F.coalesce(F.max("value"), F.lit(default)).alias("max_value"))


def fill_defaults(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def level_asof(cells: DataFrame, tiles: DataFrame, key: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Each cell with its own tile or that of its nearest ancestor, among tiles equal to it in the columns `on` (of the key).

    tiles: patch, level, path (each once for each value of `on`) plus payload; payload columns come back with
    found_level. The levels in use are joined finest first, each with the cells still
    open, so few cells are left to meet at the coarse tiles.
    """
    payload = [c for c in tiles.columns if c not in ("patch", "level", "path", *on)]
    rest = cells.select(*key, "patch", "level", "path")
    columns, out = rest.columns, None
    for level in sorted((r[0] for r in tiles.select("level").distinct().collect()), reverse=True):  # at most 24
        here = tiles.where(F.col("level") == level).select(*on, "patch", F.col("path").alias("_at"), F.struct(F.lit(level).alias("found_level"), *payload).alias("_t"))
        at = F.when(F.col("level") >= level, keys.ancestor_path(F.col("path"), F.lit(level)))
        met = cut_lineage(rest.withColumn("_at", at).join(here, [*on, "patch", "_at"], "left").select(*columns, "_t"))
        found = met.where("_t IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        rest = met.where("_t IS NULL").drop("_t")
    if out is None:
        none = F.struct(F.lit(None).cast("int").alias("found_level"), *payload)
        out = cells.join(tiles.drop(*on), ["patch", "level", "path"]).select(*columns, none.alias("_t"))
    return out.select(*key, "patch", "level", "path", "_t.*")


def lattice_taps(points: DataFrame, n: int) -> DataFrame:
    """Up to four weighted vertices (gx, gy, w) around lattice positions fx, fy of a level."""
    top = side(F.col("level"), n)
    def axis(c):
        lo = F.least(F.floor(F.col(c)).cast("bigint"), top - 1)
        return lo, F.col(c) - lo
    (x, dx), (y, dy) = axis("fx"), axis("fy")
    base = points.withColumns({"_x": x, "_dx": dx, "_y": y, "_dy": dy})
    taps = [
        F.struct((F.col("_x") + i).alias("gx"), (F.col("_y") + j).alias("gy"),
                 ((F.col("_dx") if i else 1 - F.col("_dx")) * (F.col("_dy") if j else 1 - F.col("_dy"))).alias("w"))
        for j in (0, 1) for i in (0, 1)
    ]
    return base.select(*points.columns, F.inline(F.array(*taps))).where(F.col("w") > 0)


def sample_lattice(points: DataFrame, lattice: DataFrame, n: int, keys_: list[str]) -> DataFrame:
    """Bilinear value at positions (patch, level, fx, fy); nodata renormalises, all-nodata is NULL."""
    v = lattice.select("patch", "level", "gx", "gy", "value").hint("merge")  # taps are four times the points and more than Spark expects
    hit = lattice_taps(points, n).join(v, ["patch", "level", "gx", "gy"], "left")
    valid = F.col("value").isNotNull()
    return hit.groupBy(*keys_).agg(
        F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum(F.when(valid, F.col("w")))).alias("value"))


def fill_from_coarser(vertices: DataFrame, pyramid: DataFrame, n: int) -> DataFrame:
    """Vertices (patch, level, gx, gy) without a value take the nearest coarser level's, bilinearly.

    pyramid holds several levels; positions scale by the true level difference.
    """
    key = ["patch", "want_level", "want_gx", "want_gy"]
    named = [F.col("level").alias("want_level"), F.col("gx").alias("want_gx"), F.col("gy").alias("want_gy")]
    have = pyramid.where(F.col("value").isNotNull())
    rest = vertices.select("patch", *named).join(have.select("patch", *named).hint("merge"), key, "left_anti")
    out = None
    # finest level first, each with the vertices still open
    for level in sorted((r[0] for r in have.select("level").distinct().collect()), reverse=True):  # at most 24
        scale = F.pow(F.lit(2.0), (F.col("want_level") - level).cast("double"))
        pos = rest.where(F.col("want_level") > level).withColumns({"level": F.lit(level), "fx": F.col("want_gx") / scale, "fy": F.col("want_gy") / scale})
        got = cut_lineage(sample_lattice(pos, have.where(F.col("level") == level), n, key).where(F.col("value").isNotNull()))
        out = got if out is None else out.unionByName(got)
        rest = cut_lineage(rest.join(got.hint("merge"), key, "left_anti"))
    if out is None:
        out = rest.where(F.lit(False)).withColumn("value", F.lit(None).cast("double"))
    return out.select("patch", F.col("want_level").alias("level"), F.col("want_gx").alias("gx"), F.col("want_gy").alias("gy"), "value")


def kernel_table(spark: SparkSession, kernel="tent") -> DataFrame:
    """A separable kernel as (d, weight) rows."""
    weights = {"tent": TENT, "lanczos5": LANCZOS5}[kernel] if isinstance(kernel, str) else kernel
    r = len(weights) // 2
    return spark.createDataFrame([(d - r, float(w)) for d, w in enumerate(weights)], "d int, weight double")
