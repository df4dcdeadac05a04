"""Sampling images at points and combining the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.operators import sampling as S

FOLD_CHUNK = 4096
BLOCK_PIXELS = 32


def sample_points(points: DataFrame, images: DataFrame, keep: list[str]) -> DataFrame:
    """Positions sx, sy of every point (lon_deg, lat_deg) in every image that holds it."""
    return S.positions(points, images, keep).select(*keep, "image_id", "ord", "sx", "sy", "size_x", "size_y")


def chunk_reads(points: DataFrame, images: DataFrame, size: int) -> DataFrame:
    """(image_id, bx, by, samples): the samples of sample_points counted by the pixel block they fall into, where they arise."""
    return S.counts(points, images, size)


def nearest_at(points: DataFrame, images: DataFrame, px: DataFrame, keep: list[str], value: str = "value", size: int = BLOCK_PIXELS) -> DataFrame:
    """nearest of sample_points (keep, image_id, ord, value); a sample takes its pixel where it arises."""
    return S.nearest(points, images, px, keep, value, size)


def mosaic_nearest(points: DataFrame, images: DataFrame, px: DataFrame, keys: list[str], value: str = "value", size: int = BLOCK_PIXELS) -> DataFrame:
    """mosaic_latest of nearest_at: only the newest value of each group of images is a row."""
    return mosaic_latest(S.newest(points, images, px, keys, value, size), keys, value)


def nearest(samples: DataFrame, px: DataFrame, value: str = "value") -> DataFrame:
    """Value of the pixel nearest to each sample, NULL for nodata."""
    s = samples.withColumns({
        "px": F.floor(F.col("sx") + 0.5).cast("int"), "py": F.floor(F.col("sy") + 0.5).cast("int")})
    v = px.select("image_id", "px", "py", value)
    return s.join(v, ["image_id", "px", "py"], "left").drop("px", "py")


def pixel_blocks(px: DataFrame, values: list[str], size: int = BLOCK_PIXELS, packed: bool = False) -> DataFrame:
    """(image_id, bx, by, <value> arrays): blocks of size x size pixels with a halo of one pixel to the right and below.

    Arrays are dense and row-major, NULL where there is no pixel (or S.packed), so that all four pixels around a sample stand in the block of the first.
    """
    side = size + 1

    def homes(c: str) -> Column:
        b, i = F.floor(F.col(c) / size).cast("int"), F.pmod(F.col(c), F.lit(size)).cast("int")
        own = F.struct(b.alias("b"), i.alias("i"))
        return F.explode(F.when(i == 0, F.array(own, F.struct((b - 1).alias("b"), F.lit(size).alias("i")))).otherwise(F.array(own)))

    placed = px.where("px IS NOT NULL AND py IS NOT NULL")
    spread = placed.select("image_id", homes("px").alias("x"), "py", *values).select("image_id", "x", homes("py").alias("y"), *values)
    entry = F.struct((F.col("y.i") * side + F.col("x.i")).alias("at"), *[F.col(v).cast("double").alias(v) for v in values])
    grouped = spread.groupBy("image_id", F.col("x.b").alias("bx"), F.col("y.b").alias("by")).agg(F.collect_list(entry).alias("entries"))
    together = max(1, (1 << 20) // (side * side))

    def scatter(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, together):
                part = batch.slice(first, together)
                lists = part.column("entries")
                entries = lists.flatten()
                block = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                slot = block * (side * side) + entries.field("at").to_numpy()
                off = pa.array(np.arange(part.num_rows + 1) * side * side, pa.int32())
                columns = []
                for v in values:
                    value = entries.field(v)
                    there = value.is_valid().to_numpy(zero_copy_only=False)
                    dense, empty = np.zeros(part.num_rows * side * side), np.ones(part.num_rows * side * side, bool)
                    dense[slot[there]] = value.drop_null().to_numpy()
                    empty[slot[there]] = False
                    columns.append(S.packed(dense.reshape(-1, side * side), ~empty.reshape(-1, side * side)) if packed else pa.ListArray.from_arrays(off, pa.array(dense, mask=empty)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("image_id", "bx", "by")), *columns], ["image_id", "bx", "by", *values])

    kind = px.schema["image_id"].dataType.simpleString()
    return grouped.mapInArrow(scatter, f"image_id {kind}, bx int, by int, " + ", ".join(f"{v} {'binary' if packed else 'array<double>'}" for v in values))


def _corner(c: str, extent: str) -> tuple[Column, Column]:
    """First of the two pixels a sample lies between along an axis, and its place between them."""
    lo = F.floor(F.col(c)).cast("int")
    edge = (lo == F.col(extent) - 1) & (lo > 0)
    return F.when(edge, lo - 1).otherwise(lo), F.when(edge, F.lit(1.0)).otherwise(F.col(c) - F.floor(F.col(c)))


def _weigh(met: DataFrame, keys: list[str], values: list[str], size: int) -> DataFrame:
    """Sums over the four pixels of each sample (_x, _dx, _y, _dy) in its block (bx, by, _v_<value> arrays)."""
    met = met.withColumn("_at", (F.col("_y") - F.col("by") * size) * (size + 1) + F.col("_x") - F.col("bx") * size)
    taps = [((F.col("_dx") if i else 1 - F.col("_dx")) * (F.col("_dy") if j else 1 - F.col("_dy")), F.col("_at") + (j * (size + 1) + i)) for j in (0, 1) for i in (0, 1)]
    zero = F.lit(0.0)
    total = lambda v: sum((w * F.coalesce(F.get("_v_" + v, at), zero) for w, at in taps), zero)
    valid = sum((F.when(F.get("_v_" + values[0], at).isNotNull(), w).otherwise(zero) for w, at in taps), zero)
    return met.select(*keys, *[total(v).alias(v + "_sum") for v in values], valid.alias("w_valid"))


def bilinear_parts(samples: DataFrame, px: DataFrame, keys: list[str], values: list[str], size: int = BLOCK_PIXELS) -> DataFrame:
    """Per sample: weighted sum <v>_sum of valid taps and their total weight w_valid.

    A sample meets one row, the block of its first pixel, and takes its four pixels from there; the far border uses the
    pixel before it. A pixel counts as valid when its first value is not NULL.
    """
    (x, dx), (y, dy) = _corner("sx", "size_x"), _corner("sy", "size_y")
    base = samples.withColumns({"_x": x, "_dx": dx, "_y": y, "_dy": dy})
    base = base.withColumns({"bx": F.floor(F.col("_x") / size).cast("int"), "by": F.floor(F.col("_y") / size).cast("int")})
    blocks = pixel_blocks(px, values, size).select("image_id", "bx", "by", *[F.col(v).alias("_v_" + v) for v in values])
    return _weigh(base.join(blocks.hint("merge"), ["image_id", "bx", "by"], "left"), keys, values, size)


def bilinear_at(points: DataFrame, images: DataFrame, px: DataFrame, keep: list[str], values: list[str], size: int = BLOCK_PIXELS) -> DataFrame:
    """bilinear_parts of sample_points, keyed by keep, image_id and ord; a sample takes its pixels where it arises."""
    return S.bilinear(points, images, pixel_blocks(px, values, size, packed=True), keep, values, size)


def unhidden_parts(points: DataFrame, images: DataFrame, px: DataFrame, key: str, size: int = BLOCK_PIXELS) -> DataFrame:
    """The parts (key, image_id, ord, value_sum, w_valid) that count in an ordered mosaic without a base.

    An image with weight one leaves nothing of the images before it, so those before the last such image of a
    point are not carried on. What is left is of the size of the visible images, not of all.
    """
    return S.unhidden(points, images, pixel_blocks(px, ["value"], size, packed=True), key, "value", size)


def blend(total: Column, w_valid: Column, prev: Column) -> Column:
    """Missing taps take the earlier value; without one the weights are renormalised."""
    return F.when(prev.isNotNull(), total + (1 - w_valid) * prev).when(w_valid > 0, F.try_divide(total, w_valid))


def to_byte(c: Column) -> Column:
    """Clamp to 0..255 and round half up."""
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def bilinear(samples: DataFrame, px: DataFrame, keys: list[str], prev: Column | None = None) -> DataFrame:
    parts = bilinear_parts(samples, px, keys, ["value"])
    p = F.lit(None).cast("double") if prev is None else prev
    return parts.select(*keys, blend(F.col("value_sum"), F.col("w_valid"), p).alias("value"))


def bilinear_rgb(samples: DataFrame, px: DataFrame, keys: list[str], bands=("r", "g", "b")) -> DataFrame:
    parts = bilinear_parts(samples, px, keys, list(bands))
    none = F.lit(None).cast("double")
    return parts.select(*keys, *[to_byte(blend(F.col(b + "_sum"), F.col("w_valid"), none)).alias(b) for b in bands])


def mosaic_latest(values: DataFrame, keys: list[str], value: str = "value", order: str = "ord") -> DataFrame:
    """Later images overwrite earlier ones where they have data (exact for nearest sampling)."""
    v = values.where(F.col(value).isNotNull())
    return v.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def _fold(entries: Column) -> Column:
    """Compose ordered maps prev -> a + b * prev, n being the result without an earlier value."""
    typ = "struct<a:double,b:double,n:double>"
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("double").alias("n"))
    return F.aggregate(
        entries, start.cast(typ),
        lambda acc, e: F.struct(
            (e["a"] + e["b"] * acc["a"]).alias("a"), (acc["b"] * e["b"]).alias("b"),
            F.when(acc["n"].isNotNull(), e["a"] + e["b"] * acc["n"]).otherwise(e["n"]).alias("n"),
        ).cast(typ))


def mosaic_blend(parts: DataFrame, keys: list[str], order: str = "ord", base: Column | None = None, chunk: int = FOLD_CHUNK) -> DataFrame:
    """Ordered mosaic of bilinear samples, where holes blend with the earlier images.

    Each image acts on the value before it as an affine map; maps are composed within
    chunks of the image order first, so a place under very many images is never
    gathered into one group.
    """
    total, w = F.col("value_sum"), F.col("w_valid")
    maps = parts.select(
        *keys, F.col(order), F.floor(F.col(order) / chunk).alias("_chunk"),
        total.alias("a"), (1 - w).alias("b"), F.when(w > 0, F.try_divide(total, w)).alias("n"))
    def compose(df, by, order_col):
        return df.groupBy(*by).agg(_fold(F.array_sort(F.collect_list(F.struct(F.col(order_col), "a", "b", "n")))).alias("_f")).select(*by, "_f.*")
    out = compose(compose(maps, [*keys, "_chunk"], order), keys, "_chunk")
    if base is None:
        return out.select(*keys, F.col("n").alias("value"))
    return out.select(*keys, F.when(base.isNotNull(), F.col("a") + F.col("b") * base).otherwise(F.col("n")).alias("value"))


# per-pixel combinations that skip nodata

def avg_valid(*cols: Column) -> Column:
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, n.cast("double"))


def min_valid(*cols: Column) -> Column:
    return F.least(*cols)


def max_valid(*cols: Column) -> Column:
    return F.greatest(*cols)


def avg_byte(*cols: Column) -> Column:
    return F.floor(avg_valid(*cols) + 0.5).cast("int")
