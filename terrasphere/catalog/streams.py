"""Windowed statistics, usage and stale coverage, on a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrasphere.catalog import sqlkit as S
from terrasphere.catalog.base import ORACLE, ora, query
from terrasphere.catalog.coverage import COV, bridge
from terrasphere.catalog.geo import vq
from terrasphere.catalog.grid import P, PATCHED, points, walk
from terrasphere.catalog.lines import edits
from terrasphere.catalog.views import missing
from terrasphere.fixtures import LATTICE_N, VIEWS
from terrasphere.functions.vec import V3, put, quantize
from terrasphere.operators import grid as G
from terrasphere.operators import homography as H
from terrasphere.plans.build import build
from terrasphere.session import checkpoint_root
from terrasphere.sources.pyramid_store import read_pyramid
from terrasphere.streaming import jobs

C = F.col

TUMBLE = f"""
SELECT time_bucket(INTERVAL '6 hours', ts) AS start, patch, CAST(level AS INTEGER) AS level, path, CAST(count(*) AS BIGINT) AS points, min(p.elev) AS min_value, max(p.elev) AS max_value,
 {S.q('sum(p.elev)', 100)} AS sum_value FROM walk w JOIN geo_points p USING (point_id) WHERE w.level=2 GROUP BY ALL"""


def _out(df):
    return df.select(C("w.start").cast("timestamp_ntz").alias("start"), "patch", "level", "path", "points", "min_value", "max_value",
                     quantize(C("sum_value"), 100).alias("sum_value"))


@query("stm_ingest_points", ora("geo_points", TUMBLE, *walk(2), recursive=True))
def _(fx):
    return _out(jobs.ingest_points(fx.geo_points, 2, "6 hours", value="elev"))


@query("stm_ingest_points_sliding", ora("geo_points", f"""
SELECT s.start, patch, CAST(level AS INTEGER) AS level, path, CAST(count(*) AS BIGINT) AS points, min(p.elev) AS min_value, max(p.elev) AS max_value, {S.q('sum(p.elev)', 100)} AS sum_value
FROM walk w JOIN geo_points p USING (point_id), LATERAL (SELECT time_bucket(INTERVAL '3 hours', p.ts)-k.k*INTERVAL '3 hours' AS start FROM (VALUES (0),(1)) AS k(k)) s WHERE w.level=2 GROUP BY ALL""", *walk(2), recursive=True))
def _(fx):
    return _out(jobs.ingest_points(fx.geo_points, 2, "6 hours", "3 hours", value="elev"))


@query("stm_ingest_points_stream", ora("geo_points", TUMBLE, *walk(2), recursive=True))
def _(fx):
    """The same input through a stream, one trigger; the newest state of every window is kept."""
    spark = fx.spark
    schema = fx.table("events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir)
    events.createOrReplaceTempView("events_stream")
    pts = spark.sql(VIEWS["geo_points"].replace("FROM events", "FROM events_stream"))
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(root + "/out")

    q = (
        jobs.ingest_points(pts, 2, "6 hours", value="elev").writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(root + "/out")
    newest = out.groupBy("w", "patch", "level", "path").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("w", "patch", "level", "path")]), "batch_id").alias("s"))
    return _out(newest.select("w", "patch", "level", "path", "s.*"))


@query("stm_recently_used", ora("geo_points", """
SELECT user_id, patch, max(ts) AS last_used, CAST(count(*) AS BIGINT) AS touches, CAST(row_number() OVER (ORDER BY max(ts), user_id, patch) AS INTEGER) AS rank
FROM geo_points JOIN patched USING (point_id) GROUP BY ALL QUALIFY rank<=50""".replace("GROUP BY ALL", "GROUP BY user_id, patch"), *PATCHED))
def _(fx):
    """The fifty least recently touched (layer, cell) pairs, users standing in for layers."""
    t = G.with_patch(points(fx), P).select("user_id", "patch", "ts")
    return jobs.least_recently_used(jobs.recently_used(t, ["user_id", "patch"]), ["user_id", "patch"], 50)


@query("stm_activity_bursts", ora("geo_points", """
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS touches FROM (
 SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w>=INTERVAL '12 hours' THEN 1 ELSE 0 END AS nw FROM geo_points WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, s"""))
def _(fx):
    b = jobs.activity_bursts(fx.geo_points, ["user_id"], "12 hours")
    return b.select("user_id", C("w.start").cast("timestamp_ntz").alias("start"), "touches")


@query("stm_stale_coverage", ora("geo_points line_points line_edits", """
SELECT c.patch, CAST(c.level AS INTEGER) AS level, c.path, min(e.edit_ts) AS edit_ts FROM lcov c JOIN line_edits e USING (line_id)
WHERE c.path%4=1 OR e.edit_ts>=TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL""", *COV, recursive=True))
def _(fx):
    """Line data of all cells is as of 10 January, but for those whose path ends in child 1, which have none."""
    stamp = F.when(C("path") % 4 != 1, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    b = bridge(fx).select("line_id", "patch", "level", "path").distinct().withColumn("data_stamp", stamp)
    out = jobs.stale_coverage(fx.line_edits, b)
    return out.withColumn("edit_ts", C("edit_ts").cast("timestamp_ntz"))


def _through_stream(fx, rows, name, start):
    """Write rows as the input of a stream, start it on them and wait; returns its scratch folder."""
    root = f"{checkpoint_root(fx.spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/in")
    stream = fx.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    start(stream, root).awaitTermination()
    return root


@query("stm_pyramid_update", ORACLE["pyr_update"])
def _(fx):
    """Changes of a third of the patches arrive as a stream and are applied to the built pyramid."""
    path = f"{checkpoint_root(fx.spark)}/pyramid-{uuid.uuid4().hex}"
    build(fx.spark, fx.lattice, path, LATTICE_N)
    old = fx.lattice.where((C("patch") % 3 == 0) & (C("gx") % 2 == 0)).withColumn("ts", F.lit(1))
    new = old.withColumns({"value": C("value") + 100, "ts": F.lit(2)})
    _through_stream(fx, old.unionByName(new), "changes", lambda s, root: jobs.pyramid_update(s, path, LATTICE_N, f"{root}/ckpt"))
    return read_pyramid(fx.spark, path).select("patch", "level", "gx", "gy", quantize(C("value"), 1e4).alias("value"))


@query("stm_line_edits", ORACLE["vec_apply_edits"])
def _(fx):
    """All edits arrive as one batch of a stream onto the stored control points."""
    store = f"{checkpoint_root(fx.spark)}/lines-{uuid.uuid4().hex}"
    cols = ["lon_deg", "lat_deg"]
    fx.line_points.select("line_id", "ord", *cols).write.parquet(f"{store}/version=0")
    _through_stream(fx, edits(fx), "edits", lambda s, root: jobs.line_edits(s, store, cols, f"{root}/ckpt"))
    return jobs.latest_lines(fx.spark, store).select("line_id", "ord", *cols)


@query("stm_request_queue", ORACLE["lod_coalesce_requests"])
def _(fx):
    """All requests of a trigger merged; what is handed on is kept."""
    def start(stream, root):
        return jobs.request_queue(stream, lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out"), f"{root}/ckpt", 8)

    root = _through_stream(fx, missing(fx).select("patch", "level", "path", "lod"), "requests", start)
    return fx.spark.read.parquet(f"{root}/out").select("patch", "level", "path", "rank", quantize(C("lod"), 1e4).alias("lod"))


_M = ((1.1, 0.1, 0.0, 0.3), (0.05, 0.9, 0.2, -0.2), (0.0, 0.15, 1.2, 0.1), (0.02, 0.03, 0.01, 1.5))


def _row(i, x, y, z):
    return f"({_M[i][0]}*{x}+{_M[i][1]}*{y}+{_M[i][2]}*{z}+{_M[i][3]})"


@query("geo_fit_homography", ora("geo_points", "SELECT point_id, " + ", ".join(
    S.q(f"{_row(i, 'sx', 'sy', 'sz')}/{_row(3, 'sx', 'sy', 'sz')}", 1e4) + f" AS h{a}" for i, a in enumerate("xyz"))
    + f" FROM (SELECT *, {', '.join(f'p{a}*(1+(point_id%17)/10.0) AS s{a}' for a in 'xyz')} FROM patched)", *PATCHED))
def _(fx):
    """Five pairs per base patch made by a known projective map; the fit is applied to all points."""
    df = G.with_patch(points(fx), P)
    df = put(df, s=P * (1 + (C("point_id") % 17) / 10.0))
    s = V3.of("s")
    row = lambda i: s.x * _M[i][0] + s.y * _M[i][1] + s.z * _M[i][2] + _M[i][3]
    df = put(df, d=V3(row(0) / row(3), row(1) / row(3), row(2) / row(3))).select("point_id", "patch", "sx", "sy", "sz", "dx", "dy", "dz")
    fit = H.fit_homography(df, ["patch"], "point_id")
    return df.join(fit, "patch").select("point_id", *vq("h", H.apply_homography(s, C("m")), 1e4))
