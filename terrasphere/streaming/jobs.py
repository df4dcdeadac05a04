"""Structured Streaming jobs. Every function takes a DataFrame; the windowed ones also run
on a batch, so both forms can be compared.

Event time must be TIMESTAMP: cast TIMESTAMP_NTZ with the session time zone in UTC first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrasphere.functions.vec import V3, put
from terrasphere.functions.sphere import sph_to_cart
from terrasphere.operators.grid import with_cell
from terrasphere.operators.lines import apply_edits
from terrasphere.operators.lod import coalesce_requests
from terrasphere.operators.ordered import top_k
from terrasphere.plans.build import update
from terrasphere.session import cut_lineage
from terrasphere.sources.pyramid_store import drop_folders

KEY = ["patch", "level", "path"]
BUCKETS = 64


def ingest_points(points: DataFrame, level: int, width: str, slide: str | None = None, watermark: str = "1 hour", value: str = "value") -> DataFrame:
    """Count, range and sum of values per cell and event-time window (ts, lon_deg, lat_deg, value).

    Rows later than the watermark are dropped by the stream; on a batch the watermark has no effect.
    """
    df = put(points, p=sph_to_cart(F.radians("lon_deg"), F.radians("lat_deg"))).withColumn("ts", F.col("ts").cast("timestamp"))
    cells = with_cell(df.withWatermark("ts", watermark), V3.of("p"), level)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return cells.groupBy(span.alias("w"), *KEY).agg(
        F.count(F.lit(1)).alias("points"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum(value).alias("sum_value"))


def pyramid_update(changes: DataFrame, path: str, n: int, checkpoint: str, layer: str = "dem", **trigger) -> StreamingQuery:
    """Stream of changed finest vertices: each micro-batch recomputes only the tiles above it.

    A batch that is repeated after a failure writes the same partitions again.
    """
    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("patch", "level", "gx", "gy").agg(F.max_by("value", "ts").alias("value"))
        update(batch.sparkSession, path, latest, n, layer)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def line_edits(edits: DataFrame, store: str, cols: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Stream of line edits onto a table of control points under `store`.

    version=0 is the start. Lines are dealt to BUCKETS by hash; batch b writes the buckets
    it touches to changed/version=b+1, and a bucket's newest version counts. A repeated
    batch overwrites its own version. Edits are joined and renumbered in chunks, so a hot
    line is not kept in the state of one task.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(_bucket().alias("bucket")).distinct()  # at most BUCKETS rows
        buckets = [r.bucket for r in touched.collect()]
        if not buckets:
            return
        current = _lines(batch.sparkSession, store, cols, batch_id).where(F.col("bucket").isin(buckets))
        after = apply_edits(current, batch, cols).withColumn("bucket", _bucket())
        # a row without a line marks every bucket as written, also one that lost all its lines
        mark = touched.select(*[F.lit(None).cast(t).alias(c) for c, t in after.dtypes if c != "bucket"], "bucket")
        after.unionByName(mark).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/changed/version={batch_id + 1}")

    return edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _bucket():
    return F.pmod(F.xxhash64("line_id"), F.lit(BUCKETS)).cast("int")


def _lines(spark: SparkSession, store: str, cols: list[str] | None, upto: int | None) -> DataFrame:
    """Control points after the batches up to version `upto`, with their bucket."""
    start = spark.read.parquet(f"{store}/version=0")
    cols = cols or [c for c in start.columns if c not in ("line_id", "ord")]
    start = start.select("line_id", "ord", *cols, _bucket().alias("bucket"))
    try:
        changed = spark.read.parquet(f"{store}/changed")
    except AnalysisException:  # no batch has been applied yet
        return start
    if upto is not None:
        changed = changed.where(F.col("version") <= upto)
    newest = changed.where("line_id IS NULL").groupBy("bucket").agg(F.max("version").alias("version"))
    latest = changed.join(newest, ["bucket", "version"], "left_semi").where("line_id IS NOT NULL")
    return start.join(newest, "bucket", "left_anti").unionByName(latest.select(*start.columns))


def latest_lines(spark: SparkSession, store: str) -> DataFrame:
    """Control points of the newest version."""
    return _lines(spark, store, None, None).drop("bucket")


def stale_coverage(edits: DataFrame, bridge: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Cells (KEY, edit_ts) whose line data (line_id, KEY, data_stamp) is missing or not newer than an
    edit of the line, with the first edit that made them stale: a stream-static join, each cell once
    within the watermark."""
    e = edits.select("line_id", F.col("edit_ts").cast("timestamp").alias("edit_ts"))
    if edits.isStreaming:
        e = e.withWatermark("edit_ts", watermark)
    stamp = F.col("data_stamp").cast("timestamp")
    hit = e.join(bridge, "line_id").where(stamp.isNull() | (stamp <= F.col("edit_ts")))
    if edits.isStreaming:
        return hit.select(*KEY, "edit_ts").dropDuplicatesWithinWatermark(KEY)
    return hit.groupBy(*KEY).agg(F.min("edit_ts").alias("edit_ts"))


def request_queue(requests: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, k: int = 8, **trigger) -> StreamingQuery:
    """Per trigger: merge requests per cell with their smallest lod, hand the k most urgent to emit."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        emit(coalesce_requests(batch, k), batch_id)

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


PENDING = "patch int, level int, path bigint, lod double, ts timestamp, rank int, handed bigint"


def pending_requests(requests: DataFrame, emit: Callable[[DataFrame, int], None], store: str, checkpoint: str, k: int = 8, most: int = 1024,
                     expiry_seconds: int = 600, **trigger) -> StreamingQuery:
    """A queue of requests (KEY, lod, ts) across triggers: each hands the k most urgent on, none twice while it is pending.

    What is pending is a table under `store`, one version a batch: requests handed on (by batch `handed`) until they expire, and
    at most `most` others, the most urgent by |lod|. Time is the largest ts seen. A request that was handed on longer ago than the
    expiry may be asked again; one that waits goes when nobody repeats it for that long. A repeated batch starts from
    the version before it and hands on the same rows.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(PENDING).parquet(f"{store}/version={batch_id}") if batch_id else spark.createDataFrame([], PENDING)
        new = cut_lineage(batch.groupBy(*KEY).agg(F.min("lod").alias("lod"), F.max(F.col("ts").cast("timestamp")).alias("ts")))
        clock = old.select("ts").unionByName(new.select("ts")).agg(F.max("ts")).first()[0]
        live = old.where(F.col("ts") > F.lit(clock) - F.make_dt_interval(secs=F.lit(expiry_seconds))) if clock else old
        handed = live.where("handed IS NOT NULL")
        waiting = live.where("handed IS NULL").select(*KEY, "lod", "ts").unionByName(new).join(handed, KEY, "left_anti")
        waiting = waiting.groupBy(*KEY).agg(F.min("lod").alias("lod"), F.max("ts").alias("ts"))
        ranked = coalesce_requests(waiting, k + most).select(*KEY, "rank").join(waiting, KEY)
        first = F.col("rank") <= k
        ranked = ranked.select(*KEY, "lod", F.when(first, F.lit(clock)).otherwise(F.col("ts")).alias("ts"), F.col("rank").cast("int").alias("rank"), F.when(first, F.lit(batch_id)).cast("bigint").alias("handed"))
        path = f"{store}/version={batch_id + 1}"
        handed.select(*ranked.columns).unionByName(ranked).write.mode("overwrite").parquet(path)
        emit(spark.read.schema(PENDING).parquet(path).where(F.col("handed") == batch_id).select(*KEY, "lod", "rank"), batch_id)
        if batch_id:
            drop_folders(spark, [f"{store}/version={batch_id - 1}"])

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def recently_used(touches: DataFrame, keys: list[str]) -> DataFrame:
    """Last touch of every key (ts); as a stream use output mode update or complete."""
    return touches.groupBy(*keys).agg(F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("touches"))


def least_recently_used(used: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k keys to give up first."""
    return top_k(used.withColumn("_all", F.lit(0)), ["_all"], [F.col("last_used"), *[F.col(c) for c in keys]], k).drop("_all")


def activity_bursts(touches: DataFrame, keys: list[str], gap: str, watermark: str = "1 hour") -> DataFrame:
    """Session windows of touches per key."""
    t = touches.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return t.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("touches"))



