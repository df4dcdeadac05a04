"""Map lines: segments, lengths, edits and derived attributes.

Control points are rows (line_id, ord, ...) with a dense 1-based order; positions are
vector columns x, y, z or lon_deg, lat_deg, elev. Segment ord joins points ord and ord + 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS
from terrasphere.functions.sphere import cart_to_geodetic, geodetic_to_cart, to_scaled
from terrasphere.functions.vec import V3, put, quantize, ratio
from terrasphere.operators.ordered import CHUNK_ROWS, dense_order, forward_fill, running_sum, with_neighbors

KEY = ["patch", "level", "path"]
SEG = ["line_id", "seg"]


def positions(points: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """Add x, y, z from lon_deg, lat_deg, elev."""
    return put(points, **{"": geodetic_to_cart(F.col("lon_deg"), F.col("lat_deg"), F.col("elev"), radius)})


def segments(points: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Consecutive point pairs (line_id, seg, a*, b*); extra columns come from the start point."""
    nxt = with_neighbors(points, "line_id", lead={"x": "bx", "y": "by", "z": "bz"})
    start = [F.col(c).alias("a" + c) for c in "xyz"]
    return nxt.where(F.col("bx").isNotNull()).select(
        "line_id", F.col("ord").alias("seg"), *(extra or []), *start, "bx", "by", "bz")


def cumulative_length(points: DataFrame, vertical_scale: float = 1.0, radius: float = EARTH_RADIUS) -> DataFrame:
    """Add coord: running length along the vertically scaled line, 0 at its first point."""
    scaled = put(points, _s=to_scaled(V3.of(""), vertical_scale, radius))
    prev = with_neighbors(scaled, "line_id", lag={"_sx": "_px", "_sy": "_py", "_sz": "_pz"})
    step = F.coalesce(V3.of("_s").dist(V3.of("_p")), F.lit(0.0))
    out = running_sum(prev.withColumn("_d", step), "line_id", "_d", "coord")
    return out.drop("_d", *[f"_{v}{a}" for v in "sp" for a in "xyz"])


def apply_edits(points: DataFrame, edits: DataFrame, cols: list[str]) -> DataFrame:
    """Apply a batch of edits addressed to the current order, then renumber.

    edits: line_id, edit_id (sequence), op, ord (target), and the position columns.
    Ops: remove, move (the latest wins), refine (insert after ord), add_front, add_back,
    set (replaces all points of the line; its points keep their sequence).
    """
    e = edits.select("line_id", "edit_id", "op", "ord", *cols)
    reset = e.where("op = 'set'").select("line_id").distinct()
    kept = points.select("line_id", "ord", *cols).join(reset, "line_id", "left_anti")
    kept = kept.join(e.where("op = 'remove'").select("line_id", "ord"), ["line_id", "ord"], "left_anti")
    moves = e.where("op = 'move'").groupBy("line_id", "ord").agg(F.max_by(F.struct(*cols), "edit_id").alias("_m"))
    moved = kept.join(moves, ["line_id", "ord"], "left").select(
        "line_id", F.lit(1).alias("_group"), F.col("ord").alias("_at"), F.lit(-1).cast("bigint").alias("_seq"),
        *[F.coalesce(F.col("_m." + c), F.col(c)).alias(c) for c in cols])

    def added(op, group, at, seq):
        return e.where(F.col("op") == op).select("line_id", F.lit(group).alias("_group"), at.alias("_at"), seq.alias("_seq"), *cols)

    seq = F.col("edit_id")
    inserts = (
        added("refine", 1, F.col("ord"), -seq - 2 + F.lit(1 << 62)).unionByName(added("add_front", 0, -seq, seq))
        .unionByName(added("add_back", 2, seq, seq)).unionByName(added("set", 1, seq, seq)))
    chunk = F.struct("_group", F.floor(F.col("_at") / CHUNK_ROWS).alias("_c"))
    out = dense_order(moved.unionByName(inserts), "line_id", ["_group", "_at", "_seq"], chunk)
    return out.select("line_id", "ord", *cols)


def affected_segments(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Existing segments an edit invalidates: only those next to its point."""
    size = points.groupBy("line_id").agg(F.max("ord").alias("_n"))
    e = edits.join(size, "line_id")
    at = F.when(F.col("op").isin("move", "remove"), F.array(F.col("ord") - 1, F.col("ord")))
    at = at.when(F.col("op") == "refine", F.array("ord"))
    at = at.otherwise(F.array().cast("array<bigint>"))
    return (
        e.select("line_id", "_n", F.explode(at).alias("seg")).where((F.col("seg") >= 1) & (F.col("seg") < F.col("_n")))
        .select("line_id", "seg").distinct())


def adjacent_controls(points: DataFrame) -> DataFrame:
    """Previous and next segment of every point, previous and next point of its segment."""
    nxt = with_neighbors(points, "line_id", lead={"ord": "_next"})
    last = F.col("_next").isNull()
    return nxt.select(
        "line_id", "ord", F.when(F.col("ord") > 1, F.col("ord") - 1).alias("prev_segment"),
        F.when(~last, F.col("ord")).alias("next_segment"), F.when(~last, F.col("ord")).alias("segment_start"),
        F.when(~last, F.col("_next")).alias("segment_end"))


def segment_attributes(bridge: DataFrame, segs: DataFrame, cells: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per cell and segment: ends relative to the cell's centroid (mx, my, mz), cumulative
    coordinates, plane normal and symbol."""
    n = V3.of("a").cross(V3.of("b"))
    s = put(segs, n=n.unit())
    df = bridge.join(s, SEG).join(cells.select(*KEY, "mx", "my", "mz"), KEY).join(symbols, "symbol_id", "left")
    return put(df, ra=V3.of("a") - V3.of("m"), rb=V3.of("b") - V3.of("m"))


def stale_cells(bridge: DataFrame, data: DataFrame) -> DataFrame:
    """Cells whose line data (KEY, data_stamp) is missing or not newer than their newest segment stamp."""
    newest = bridge.groupBy(*KEY).agg(F.max("stamp").alias("newest"))
    return newest.join(data, KEY, "left").where(F.col("data_stamp").isNull() | (F.col("data_stamp") <= F.col("newest"))).select(*KEY)


def set_symbol(points: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Reassign symbols (line_id, new_symbol); all points of a changed line get the new stamp."""
    df = points.join(changes, "line_id", "left")
    hit = F.col("new_symbol").isNotNull()
    return df.withColumns({
        "symbol_id": F.coalesce("new_symbol", "symbol_id"), "stamp": F.when(hit, now).otherwise(F.col("stamp"))}).drop("new_symbol")


def line_uv(samples: DataFrame, segs: DataFrame, width: float, length: float, symbol_length: Column) -> DataFrame:
    """Coordinates (u, v) of samples (KEY, p*, s* surface normal) on the segments of their cell.

    v is the lateral offset over the width, corrected for slope; |v| > 1 and u outside
    the segment are rejected. u repeats with the symbol.
    """
    p, a, b, n, s = (V3.of(k) for k in ("p", "a", "b", "n", "s"))
    df = samples.join(put(segs, n=a.cross(b).unit()), KEY)
    snn = n.dot(s)
    df = df.withColumn("v", ratio((p - a).dot(n), F.sqrt(F.greatest(1 - snn * snn, F.lit(0.0)))) / F.lit(float(width)))
    df = put(df.where(F.abs("v") <= 1), w=n.cross(p))
    w, e = V3.of("w"), b - a
    df = df.withColumn("_t", ratio(p.dot(w) - a.dot(w), e.dot(w))).where(F.col("_t").between(0, 1))
    along = ratio((p - a).dot(e), e.dot(e))
    run = (F.col("a_coord") + (F.col("b_coord") - F.col("a_coord")) * along) * F.lit(float(length)) / symbol_length
    return df.withColumn("u", run - F.floor(run)).drop("_t", "wx", "wy", "wz")


def line_corridor(uv: DataFrame, sample_key: str) -> DataFrame:
    """Samples inside any corridor: how many segments cover them, and the nearest by |v|."""
    return uv.groupBy(sample_key).agg(
        F.count(F.lit(1)).alias("covers"),
        F.min_by(F.struct("line_id", "seg", "u", "v"), F.struct(quantize(F.abs("v"), 1e9), "line_id", "seg")).alias("best")
    ).select(sample_key, "covers", F.when(F.col("covers") > 1, "multiple").otherwise("single").alias("coverage"), "best.*")


def unwrap_rings(vertices: DataFrame, key: str) -> DataFrame:
    """Vertices (key, ord dense from 1, lon, lat in radians) with consecutive longitudes near each other.

    Turns over the antimeridian are counted by a running sum in chunks, so a ring of any
    length is spread over tasks. A vertex at a pole takes the longitude before it; leaving
    a pole adds a pole vertex (part 0, before part 1) at the new longitude.
    """
    pole = F.abs(F.lit(math.pi / 2) - F.abs(F.col("lat"))) < 1e-5
    v = vertices.withColumn("_lon", F.when(~pole | (F.col("ord") == 1), F.col("lon")))
    v = forward_fill(v, ["_lon"], keys=[key])
    v = with_neighbors(v, key, lag={"_lon": "_back", "lat": "_lat"})
    step = F.col("_lon") - F.col("_back")
    v = running_sum(v.withColumn("_turn", F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)), key, "_turn", "_turns")
    lon = F.col("_lon") + 2 * math.pi * F.col("_turns")
    leaving = F.coalesce(F.abs(F.lit(math.pi / 2) - F.abs(F.col("_lat"))) < 1e-5, F.lit(False))
    own = F.struct(F.lit(1).alias("part"), lon.alias("lon"), F.col("lat").alias("lat"))
    extra = F.struct(F.lit(0).alias("part"), lon.alias("lon"), F.col("_lat").alias("lat"))
    return v.select(key, "ord", F.inline(F.when(leaving, F.array(extra, own)).otherwise(F.array(own))))


def allocate_ids(new: DataFrame, order_by: str, used: DataFrame, id_col: str = "id") -> DataFrame:
    """Unique dense ids for new rows: released ids first, then above the highest.

    The released ids are the gaps between neighbouring used ones. Each gap (and the open
    end) starts at a rank, so a new row finds its id from the gap that holds its rank;
    nothing is generated for ids that no row takes.
    """
    ids = used.select(F.col(id_col).cast("bigint").alias("_id")).where("_id > 0").distinct()
    ids = ids.unionByName(ids.sparkSession.range(1).select(F.col("id").alias("_id")))
    ids = dense_order(ids.withColumn("_k", F.lit(0)), "_k", ["_id"], F.floor(F.col("_id") / CHUNK_ROWS))
    gaps = with_neighbors(ids, "_k", lead={"_id": "_next"}).where("_next IS NULL OR _next > _id + 1")
    gaps = gaps.withColumn("_n", F.coalesce(F.col("_next") - F.col("_id") - 1, F.lit(0))).select("_k", "_id", "_n", "ord")
    gaps = dense_order(gaps.drop("ord"), "_k", ["_id"], F.floor(F.col("_id") / CHUNK_ROWS))
    gaps = running_sum(gaps, "_k", "_n", "_upto").withColumn("_first", F.col("_upto") - F.col("_n"))
    rows = dense_order(new.withColumn("_k", F.lit(0)), "_k", [order_by], F.floor(F.col(order_by) / CHUNK_ROWS), into="_rank")
    # gap starts and rows in one order of ranks: a row takes the last gap that starts below its rank
    marks = gaps.select(F.lit(0).alias("_k"), F.col("_first").alias("_at"), F.lit(0).alias("_row"), F.struct("_id", "_first").alias("_gap"))
    asks = rows.select(F.lit(0).alias("_k"), (F.col("_rank") - 1).alias("_at"), F.lit(1).alias("_row"), F.lit(None).cast("struct<_id:bigint,_first:bigint>").alias("_gap"))
    line = dense_order(marks.unionByName(asks), "_k", ["_at", "_row", F.col("_gap._id")], F.floor(F.col("_at") / CHUNK_ROWS))
    found = forward_fill(line, ["_gap"], keys=["_k"]).where("_row = 1").select(
        (F.col("_at") + 1).alias("_rank"), (F.col("_gap._id") + 1 + F.col("_at") - F.col("_gap._first")).alias("_id"))
    return rows.join(found, "_rank").withColumn(id_col, F.col("_id")).drop("_rank", "_id", "_k")


def read_geodetic(points: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """Add lon_deg, lat_deg, elev from x, y, z."""
    lon, lat, elev = cart_to_geodetic(V3.of(""), radius)
    return points.withColumns({"lon_deg": lon, "lat_deg": lat, "elev": elev})
