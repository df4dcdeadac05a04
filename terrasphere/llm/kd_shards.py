"""K-d tree sharding: space over metadata is split at weighted medians along its widest dimension.

Every row has three coordinates of 4096 buckets (log of its bytes, source, language) and a weight in bytes. A node
with k leaves sends k//2/k of its bytes to the left: along the dimension whose extent is widest, measured against
the extent over all rows. The median is found by sums alone, first over buckets, then inside the bucket that holds
it over two times twelve bits of the hash of the row's key, so equal values (a hot source, copies) are split too.
Nodes and their cuts are as many as shards, so they travel through the driver; rows are read, never gathered.

NULL texts weigh 1 byte, NULL source or language count as empty strings; rows with equal doc_id, text, source and
language stay together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasphere.llm.tables import stored, table
from terrasphere.operators.ordered import dense_order

DIMENSIONS = ("d_size", "d_source", "d_lang")
REFINE_BITS = 12
G_BITS = 32
SLOT_ROWS = 65_536  # rows that one task numbers, on average


def coordinates(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, coordinates, hash h with the text's bits first, hash g of the row) of every document."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    row = F.xxhash64("doc_id", "text", "source", "lang")
    bucket = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")), 20).cast("int")
    return docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.floor(F.log2(size.cast("double")) * 64).cast("int").alias("d_size"),
        bucket("source").alias("d_source"), bucket("lang").alias("d_lang"),
        (F.pmod(F.xxhash64("text"), F.lit(1 << REFINE_BITS)) * (1 << REFINE_BITS) + F.pmod(row, F.lit(1 << REFINE_BITS))).alias("h"),
        F.shiftrightunsigned(row, 64 - G_BITS).alias("g"))


def _descend(rows: DataFrame, cuts: dict[int, dict]) -> DataFrame:
    """Move every row to the child of its node; the cuts are fewer than the shards, so they are sent to all tasks."""
    values = ", ".join(f"({n}, '{c['dim']}', {c['bucket']}, {c['h']}L)" for n, c in cuts.items())
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, dim, cut_bucket, cut_h)")
    d = F.coalesce(*[F.when(F.col("dim") == x, F.col(x)) for x in DIMENSIONS])
    left = (d < F.col("cut_bucket")) | ((d == F.col("cut_bucket")) & (F.col("h") < F.col("cut_h")))
    out = rows.join(F.broadcast(table), "node").withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1))
    return out.drop("dim", "cut_bucket", "cut_h")


def _crossing(rows: DataFrame, key: Column, goal: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the key value where the running bytes pass the goal, the bytes before it and up to it."""
    sums = rows.groupBy("node", key.alias("k")).agg(F.sum("size").alias("b"))
    run = sums.withColumn("upto", F.sum("b").over(W.partitionBy("node").orderBy("k")))
    target = F.element_at(F.create_map(*[x for n, g in goal.items() for x in (F.lit(n), F.lit(float(g)))]), F.col("node"))
    found = run.where(F.col("upto") > target).groupBy("node").agg(F.min(F.struct("k", "upto", "b")).alias("m"))
    return {r.node: (r.m.k, r.m.upto - r.m.b, r.m.upto) for r in found.collect()}


def _cuts(rows: DataFrame, leaves: dict[int, int], extent: dict[str, float]) -> dict[int, dict]:
    """The cut of every node that has more than one leaf."""
    split = [n for n, k in leaves.items() if k > 1]
    rows = rows.where(F.col("node").isin(split))
    about = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    dim = {r.node: max(DIMENSIONS, key=lambda d, r=r: r[d] / (extent[d] or 1)) for r in about}
    goal = {r.node: r.bytes * (leaves[r.node] // 2) / leaves[r.node] for r in about}
    if not goal:
        return {n: {"dim": DIMENSIONS[0], "bucket": 0, "h": 0} for n in split}
    value = F.coalesce(*[F.when(F.col("node") == n, F.col(d)) for n, d in dim.items()])
    bucket = _crossing(rows, value, goal)
    goal = {n: goal[n] - bucket[n][1] for n in bucket}
    at = F.coalesce(*[F.when(F.col("node") == n, F.lit(b)) for n, (b, _, _) in bucket.items()])
    rows = rows.where(value == at)
    coarse = _crossing(rows, F.shiftright("h", REFINE_BITS), goal)
    goal = {n: goal[n] - coarse[n][1] for n in coarse}
    high = F.coalesce(*[F.when(F.col("node") == n, F.lit(k)) for n, (k, _, _) in coarse.items()])
    fine = _crossing(rows.where(F.shiftright("h", REFINE_BITS) == high), F.col("h"), goal)
    # the rows of the last value go to the side that brings the cut nearer to the goal
    nearer = {n: k + (upto - goal[n] < goal[n] - before) for n, (k, before, upto) in fine.items()}
    empty = {"dim": DIMENSIONS[0], "bucket": 0, "h": 0}
    return {n: {"dim": dim[n], "bucket": bucket[n][0], "h": nearer[n]} if n in fine else empty for n in split}


def shard(docs: DataFrame, n_shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes, slots gapless from 0 in each.

    With target_bytes nodes are split until no leaf is expected to hold more.
    """
    rows = stored(coordinates(docs), "kd-coordinates")
    if n_shards & (n_shards - 1):
        raise ValueError("the number of leaves must be a power of two")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    extent = {d: whole[d] or 0 for d in DIMENSIONS}
    if target_bytes:
        n_shards = 1 << (-(-(whole.bytes or 0) // target_bytes) - 1).bit_length() if whole.n else 1
    placed, leaves = rows.withColumn("node", F.lit(0)), {0: n_shards}
    while max(leaves.values()) > 1:
        placed = _descend(placed, _cuts(placed, leaves, extent))
        leaves = {2 * n + side: k // 2 for n, k in leaves.items() for side in (0, 1)}
    placed = placed.withColumnRenamed("node", "shard")
    chunk_bits = min(G_BITS, max(0, whole.n // (n_shards * SLOT_ROWS)).bit_length())
    placed = dense_order(placed, "shard", ["g", "doc_id", "text_crc32"], F.shiftright("g", G_BITS - chunk_bits), "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_kd_shards": op6_kd_shards}
ORACLE: dict[str, str] = {}
