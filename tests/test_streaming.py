import uuid

from pyspark.sql import functions as F

from terrasphere.operators import pyramid
from terrasphere.plans.build import build
from terrasphere.session import checkpoint_root
from terrasphere.sources import manifest, text, vector_files
from terrasphere.sources.pyramid_store import read_pyramid
from terrasphere.streaming import jobs


def scratch(spark):
    return f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"


def test_line_edits_apply_in_batches(spark):
    root = scratch(spark)
    start = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 1, 5.0)], "line_id bigint, ord bigint, lon_deg double")
    start.write.parquet(f"{root}/store/version=0")
    schema = "line_id bigint, edit_id bigint, op string, ord bigint, lon_deg double"
    for i, rows in enumerate(([(1, 1, "add_back", 0, 2.0), (1, 2, "add_front", 0, -1.0)], [(1, 3, "remove", 2, 0.0), (2, 4, "move", 1, 6.0), (1, 5, "refine", 1, -0.5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/b{i}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        jobs.line_edits(stream, f"{root}/store", ["lon_deg"], f"{root}/ckpt").awaitTermination()
    out = sorted((r.line_id, r.ord, r.lon_deg) for r in jobs.latest_lines(spark, f"{root}/store").collect())
    assert out == [(1, 1, -1.0), (1, 2, -0.5), (1, 3, 1.0), (1, 4, 2.0), (2, 1, 6.0)]


def test_pyramid_update_equals_a_full_build(spark):
    root, n = scratch(spark), 5
    rows = [(p, 2, x, y, float((x * 5 + y) % 13)) for p in (0, 1) for x in range(17) for y in range(17)]
    base = spark.createDataFrame(rows, "patch int, level int, gx bigint, gy bigint, value double")
    build(spark, base, f"{root}/a", n)
    changed = base.where("patch = 1 and gx between 3 and 6").withColumns({"value": F.col("value") + 50, "ts": F.lit(1)})
    changed.coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(changed.schema).parquet(f"{root}/in")
    jobs.pyramid_update(stream, f"{root}/a", n, f"{root}/ckpt").awaitTermination()
    merged = base.withColumn("value", F.when(F.expr("patch = 1 and gx between 3 and 6"), F.col("value") + 50).otherwise(F.col("value")))
    build(spark, merged, f"{root}/b", n)
    a, b = read_pyramid(spark, f"{root}/a"), read_pyramid(spark, f"{root}/b")
    # the order of summation may differ in the last bits
    a, b = (x.withColumn("value", F.round("value", 9)) for x in (a, b))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_late_rows_are_dropped_and_the_rest_agrees(spark):
    root = scratch(spark)
    schema = "ts timestamp, lon_deg double, lat_deg double, value double"
    on_time = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 2.0)]
    for i, rows in enumerate((on_time, [("2024-01-01 00:20:00", 9.0)], [("2024-01-02 00:00:00", 1.0)])):
        df = spark.createDataFrame([(t, 10.0, 10.0, v) for t, v in rows], "ts string, lon_deg double, lat_deg double, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{root}/in/b{i}")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        agg = jobs.ingest_points(stream, 1, "1 hour", watermark="1 hour")
        q = agg.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out")
        q.awaitTermination()
    out = spark.read.parquet(f"{root}/out").select("points", "sum_value").orderBy("sum_value").collect()
    assert [tuple(r) for r in out] == [(1, 1.0), (1, 2.0)]


def test_request_queue(spark):
    root, got = scratch(spark), []
    schema = "patch int, level int, path bigint, lod double"
    spark.createDataFrame([(0, 1, i % 5, float(i)) for i in range(20)], schema).coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    jobs.request_queue(stream, lambda df, _: got.extend(df.collect()), f"{root}/ckpt", k=3).awaitTermination()
    assert sorted((r.path, r.lod) for r in got) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_pending_requests_over_triggers_and_a_restart(spark):
    root, got = scratch(spark), {}
    schema = "patch int, level int, path bigint, lod double, ts timestamp"
    rows = [
        [(0, 1, k, float(k), "2024-01-01 00:00:00") for k in range(5)],  # 0 and 1 are handed on, 2 and 3 wait, 4 does not fit
        [(0, 1, 0, 0.0, "2024-01-01 00:01:00"), (0, 1, 7, 0.5, "2024-01-01 00:01:00")],  # 0 is pending: 7 and 2
        [(0, 1, 1, 0.1, "2024-01-01 00:05:00"), (0, 1, 8, 9.0, "2024-01-01 00:05:00")],  # 1 is pending: 3 and 8
        [(0, 1, 0, 0.0, "2024-01-01 00:20:00"), (0, 1, 8, 9.0, "2024-01-01 00:14:00")],  # all have expired: 0 and 8
    ]

    def put(k):
        df = spark.createDataFrame([(*r[:4], r[4]) for r in rows[k]], "patch int, level int, path bigint, lod double, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        emit = lambda df, b: got.update({b: [(r.path, r.lod) for r in df.orderBy("rank").collect()]})
        jobs.pending_requests(stream, emit, f"{root}/pending", f"{root}/ckpt", k=2, most=2, expiry_seconds=600).awaitTermination()

    for k in (0, 1):
        put(k)
        run()  # a restart between triggers
    put(2)
    run()
    put(3)
    run()
    assert got == {0: [(0, 0.0), (1, 1.0)], 1: [(7, 0.5), (2, 2.0)], 2: [(3, 3.0), (8, 9.0)], 3: [(0, 0.0), (8, 9.0)]}


def test_stale_coverage_stream(spark):
    root = scratch(spark)
    e = spark.createDataFrame([(1, "2024-01-03"), (2, "2024-01-01")], "line_id bigint, edit_ts string").withColumn("edit_ts", F.col("edit_ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{root}/in")
    b = spark.createDataFrame([(1, 0, 1, 3, "2024-01-02"), (1, 0, 0, 0, "2024-01-02"), (2, 5, 0, 0, "2024-01-02")], "line_id bigint, patch int, level int, path bigint, data_stamp string")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    q = jobs.stale_coverage(stream, b).writeStream.format("parquet").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_text_files(spark, tmp_path):
    f = tmp_path / "a.pal"
    f.write_text("# palette\n0 0 0 0 1\nbad\n1 1 1 1 1\n2 1 0 0 1\n")
    lines = text.read_lines(spark, str(f)).withColumnRenamed("path", "palette_id")
    assert [r.value for r in vector_files.parse_palettes(lines).orderBy("line_no").collect()] == [0.0, 1.0, 2.0]
    short = lines.where("line_no < 4")
    assert vector_files.parse_palettes(short).count() == 0


def test_manifest_defaults(spark):
    e = spark.createDataFrame([(1, "file", "a"), (2, "offset", "5"), (3, "file", "b"), (4, "no_offset", None), (5, "file", "c")], "ord bigint, option string, arg string")
    out = [(r.path, r.px_offset, r.px_scale, r.nodata) for r in manifest.image_manifest(e).orderBy("ord").collect()]
    assert out == [("a", 0.0, 1.0, ""), ("b", 5.0, 1.0, ""), ("c", 0.0, 1.0, "")]


def test_fill_from_coarser(spark):
    coarse = spark.createDataFrame([(0, 0, x, y, float(x + 10 * y)) for x in range(5) for y in range(5)], "patch int, level int, gx bigint, gy bigint, value double")
    want = spark.createDataFrame([(0, 2, 7, 9)], "patch int, level int, gx bigint, gy bigint")
    assert pyramid.fill_from_coarser(want, coarse, 5).first()["value"] == 7 / 4 + 90 / 4
