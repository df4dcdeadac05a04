"""Colour palettes: rows (value, r, g, b, a), optionally per palette_id, and layer blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasphere.functions.vec import ratio

RGBA = ("r", "g", "b", "a")
TABLE_SIZE = 1024


def _keyed(df: DataFrame, key: str | None) -> DataFrame:
    """One palette is a table of palettes with one id."""
    return df.withColumn("_p", F.lit(0) if key is None else F.col(key))


def intervals(palette: DataFrame, key: str | None = None) -> DataFrame:
    """Consecutive point pairs of each palette (_p): lo, hi and colours lo_*, hi_*; first and last are flagged.

    A palette is a hand-made dimension of a few points, ordered in one small window.
    """
    w = W.partitionBy("_p").orderBy("value")
    nxt = {f"hi_{c}": F.lead(c).over(w) for c in RGBA}
    df = _keyed(palette, key).withColumns({"hi": F.lead("value").over(w), "_i": F.row_number().over(w), **nxt}).where(F.col("hi").isNotNull())
    n = F.max("_i").over(W.partitionBy("_p"))
    return df.select(
        "_p", F.col("value").alias("lo"), "hi", *[F.col(c).alias(f"lo_{c}") for c in RGBA], *nxt,
        (F.col("_i") == 1).alias("is_first"), (F.col("_i") == n).alias("is_last"))


def interpolate(df: DataFrame, palette: DataFrame, value: str = "value", buckets: int = 256, key: str | None = None) -> DataFrame:
    """Add the linear colour of value. Outside the range the nearest pair extrapolates.

    With a key, rows take the palette of their own id. Intervals and values meet on a
    bucket of the palette's range: an equi-join that Catalyst broadcasts because of the
    palettes' measured size. A palette of fewer than two points gives no colour.
    """
    rng = _keyed(palette, key).groupBy("_p").agg(F.min("value").alias("_lo"), (F.max("value") - F.min("value")).alias("_w"))
    rng = rng.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w") / buckets).otherwise(F.lit(1.0)))

    def bucket(c):
        return F.least(F.greatest(F.floor((c - F.col("_lo")) / F.col("_w")), F.lit(0)), F.lit(buckets - 1)).cast("int")

    iv = intervals(palette, key).join(rng, "_p").withColumn("_b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))).drop("_lo", "_w")
    v = F.col(value)
    inside = (F.col("is_first") | (v > F.col("lo"))) & (F.col("is_last") | (v <= F.col("hi")))
    # degenerate spans between equal points never match, as their interval is empty
    left = _keyed(df, key).join(rng, "_p", "left").withColumn("_b", F.when(v.isNotNull(), bucket(v)))
    hit = left.join(iv, ["_p", "_b"], "left").where(v.isNull() | F.col("lo").isNull() | inside)
    t = ratio(v - F.col("lo"), F.col("hi") - F.col("lo"))
    return hit.select(*df.columns, *[(F.col(f"lo_{c}") * (1 - t) + F.col(f"hi_{c}") * t).alias(c) for c in RGBA])


def value_range(palette: DataFrame, key: str | None = None) -> DataFrame:
    """min_value, max_value (of each palette); NULL for fewer than two points."""
    ok = F.count(F.lit(1)) >= 2
    return palette.groupBy(*([key] if key else [])).agg(F.when(ok, F.min("value")).alias("min_value"), F.when(ok, F.max("value")).alias("max_value"))


def set_range(palette: DataFrame, new_min: float, new_max: float) -> DataFrame:
    w = W.partitionBy()
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return palette.withColumn("value", F.lit(float(new_min)) + (F.col("value") - lo) * ratio(float(new_max) - float(new_min), hi - lo))


def discretize(palette: DataFrame, k: int = TABLE_SIZE, key: str | None = None) -> DataFrame:
    """k evenly spaced colours (of each palette): idx, value, r, g, b, a."""
    rng = value_range(palette, key)
    idx = rng.where(F.col("min_value").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("idx"))
    at = idx.select(*([key] if key else []), "idx", (F.col("min_value") + (F.col("max_value") - F.col("min_value")) / (k - 1) * F.col("idx")).alias("value"))
    return interpolate(at, palette, key=key)


def shift_range(lo: Column, hi: Column, new_min: Column) -> tuple[Column, Column]:
    """Move the lower end, keeping the width."""
    return new_min, hi + (new_min - lo)


def set_min(lo: Column, hi: Column, new_min: Column) -> tuple[Column, Column]:
    return new_min, hi


def set_max(lo: Column, hi: Column, new_max: Column) -> tuple[Column, Column]:
    return lo, new_max


def insert_points(palette: DataFrame, values: DataFrame) -> DataFrame:
    """Add points at the given values with the colours interpolated there."""
    return palette.select("value", *RGBA).unionByName(interpolate(values.select("value"), palette).select("value", *RGBA))


def _numbered(palette: DataFrame) -> DataFrame:
    return palette.withColumn("_i", F.row_number().over(W.orderBy("value")) - 1)


def delete_points(palette: DataFrame, indexes: list[int]) -> DataFrame:
    """Delete by 0-based position; both ends stay."""
    last = F.max("_i").over(W.partitionBy())
    keep = ~F.col("_i").isin(indexes) | (F.col("_i") == 0) | (F.col("_i") == F.col("_last"))
    return _numbered(palette).withColumn("_last", last).where(keep).select("value", *RGBA)


def move_point(palette: DataFrame, index: int, value: float, opacity: float) -> DataFrame:
    """Move a point between its neighbours (ends keep their value) and set its opacity in 0..1."""
    w = W.orderBy("_i")
    p = _numbered(palette).withColumns({"_lo": F.lag("value").over(w), "_hi": F.lead("value").over(w)})
    at = F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), F.col("value")).otherwise(
        F.least(F.greatest(F.lit(float(value)), F.col("_lo")), F.col("_hi")))
    chosen = F.col("_i") == index
    return p.withColumns({
        "value": F.when(chosen, at).otherwise(F.col("value")),
        "a": F.when(chosen, F.lit(min(max(float(opacity), 0.0), 1.0))).otherwise(F.col("a"))}).select("value", *RGBA)


def table_index(value: Column, lo: Column, hi: Column, k: int, clamp: bool = True) -> Column:
    """Nearest entry of a k-colour table; NULL for nodata. Without clamp, out of range is NULL too."""
    s = ratio(value - lo, hi - lo)
    inside = s.between(0, 1)
    i = F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * (k - 1) + 0.5).cast("int")
    return F.when(value.isNotNull(), i) if clamp else F.when(inside, i)


def map_layer(df: DataFrame, palette: DataFrame, value: str = "value", k: int = TABLE_SIZE, clamp: bool = True, key: str | None = None) -> DataFrame:
    """Colour by table look-up, with a key by the table of each row's own palette; nodata becomes transparent black."""
    rng = _keyed(value_range(palette, key), key).select("_p", "min_value", "max_value")
    table = _keyed(discretize(palette, k, key), key).select("_p", "idx", *RGBA)
    placed = _keyed(df, key).join(rng, "_p", "left").withColumn("idx", table_index(F.col(value), F.col("min_value"), F.col("max_value"), k, clamp))
    hit = placed.join(table, ["_p", "idx"], "left")
    return hit.select(*df.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in RGBA])


def read_rgb(r: Column, g: Column, b: Column) -> list[Column]:
    """0..1 colour with alpha 0 for nodata (NULL or black), else 1."""
    nodata = r.isNull() | ((r == 0) & (g == 0) & (b == 0))
    parts = [F.coalesce(c / 255.0, F.lit(0.0)).alias(n) for c, n in zip((r, g, b), "rgb")]
    return [*parts, F.when(nodata, F.lit(0.0)).otherwise(F.lit(1.0)).alias("a")]


def _ordered(layers: DataFrame, key: list[str]) -> DataFrame:
    """Layer colours per sample in drawing order (layer count is bounded by the layer table)."""
    rank = F.when(F.col("layer_kind") == "color", 0).otherwise(1)
    return layers.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("k"), "layer_id", *RGBA))).alias("_l"))


def mix(layers: DataFrame, key: list[str]) -> DataFrame:
    """Ordered alpha-over starting from white: colour layers first, then float layers."""
    white = F.struct(*[F.lit(1.0).alias(c) for c in "rgb"])
    over = F.aggregate("_l", white, lambda acc, e: F.struct(*[(acc[c] + (e[c] - acc[c]) * e["a"]).alias(c) for c in "rgb"]))
    return _ordered(layers, key).select(*key, over.alias("_c")).select(*key, "_c.*")


def multiply(layers: DataFrame, key: list[str]) -> DataFrame:
    """Component product of all layers of a sample."""
    one = F.struct(*[F.lit(1.0).alias(c) for c in RGBA])
    prod = F.aggregate("_l", one, lambda acc, e: F.struct(*[(acc[c] * e[c]).alias(c) for c in RGBA]))
    return _ordered(layers, key).select(*key, prod.alias("_c")).select(*key, "_c.*")


def set_visibility(layers: DataFrame, layer_id: int | None, visible: bool) -> DataFrame:
    hit = F.lit(True) if layer_id is None else F.col("layer_id") == layer_id
    return layers.withColumn("visible", F.when(hit, F.lit(visible)).otherwise(F.col("visible")))


def set_clamping(layers: DataFrame, layer_id: int | None, clamped: bool) -> DataFrame:
    hit = F.col("layer_kind") != "color"
    if layer_id is not None:
        hit = hit & (F.col("layer_id") == layer_id)
    return layers.withColumn("clamped", F.when(hit, F.lit(clamped)).otherwise(F.col("clamped")))


def layer_order(layers: DataFrame) -> DataFrame:
    """Index of layers: colours, then the elevation layer, then float layers."""
    rank = F.when(F.col("layer_kind") == "color", 0).when(F.col("layer_kind") == "dem", 1).otherwise(2)
    return layers.withColumn("index", F.row_number().over(W.orderBy(rank, "layer_id")) - 1)


# The built-in palettes, from 0 to 1.
DEFAULTS = {
    "black": ((0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0)),
    "grey": ((0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0)),
    "white": ((0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0)),
}


def default_palettes(spark: SparkSession) -> DataFrame:
    rows = [(name, *p) for name, pts in DEFAULTS.items() for p in pts]
    return spark.createDataFrame(rows, "palette_id string, value double, r double, g double, b double, a double")


def with_palette(layers: DataFrame, assigned: DataFrame, elevation_range: DataFrame) -> DataFrame:
    """palette_id per layer, black where none is assigned; the elevation layer gets the global range."""
    lr = F.col("layer_kind") == "dem"
    df = layers.join(assigned, "layer_id", "left").crossJoin(F.broadcast(elevation_range))  # one row
    return df.select(
        *layers.columns, F.coalesce("palette_id", F.lit("black")).alias("palette_id"),
        F.when(lr, F.col("min_value")).otherwise(F.lit(0.0)).alias("range_min"),
        F.when(lr, F.col("max_value")).otherwise(F.lit(1.0)).alias("range_max"))
