"""Ordered operators per key that stay safe when one key holds a large share of all rows.

A window over the key alone would put a hot line into one task. Here a key is cut into
chunks along its order; each chunk is a window partition of its own, and only one
summary row per chunk is carried across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


def chunk_of(ord_col: str = "ord", rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense 1-based order."""
    return F.floor((F.col(ord_col) - 1) / F.lit(rows)).cast("bigint")


def _offsets(df: DataFrame, key: str, measure: Column) -> DataFrame:
    """Sum of the measure over all earlier chunks of the key."""
    per_chunk = df.groupBy(key, "_chunk").agg(measure.alias("_n"))
    w = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(key, "_chunk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def dense_order(df: DataFrame, key: str, order_by: list, chunk, into: str = "ord") -> DataFrame:
    """Dense 1-based position of every row in its key.

    chunk is a column or expression that is monotone in the order (a day, a range of
    the sort key), so that chunks follow each other.
    """
    chunked = df.withColumn("_chunk", chunk if isinstance(chunk, Column) else F.col(chunk))
    before = _offsets(chunked, key, F.count(F.lit(1)))
    w = W.partitionBy(key, "_chunk").orderBy(*order_by)
    ranked = chunked.withColumn("_rn", F.row_number().over(w))
    out = ranked.join(before, [key, "_chunk"])
    return out.withColumn(into, (F.col("_rn") + F.col("_before")).cast("bigint")).drop("_chunk", "_rn", "_before")


def with_neighbors(
    df: DataFrame, key: str, lead: dict[str, str] | None = None, lag: dict[str, str] | None = None,
    ord_col: str = "ord", rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add columns of the next (lead) and previous (lag) row of the same key.

    Needs a dense order. Rows at a chunk border are also copied into the adjacent chunk,
    so the window stays inside (key, chunk): one shuffle, no join.
    """
    lead, lag = lead or {}, lag or {}
    home = chunk_of(ord_col, rows)
    first = ((F.col(ord_col) - 1) % rows == 0) & (home > 0)
    last = F.col(ord_col) % rows == 0
    copies = [F.struct(home.alias("_chunk"), F.lit(True).alias("_own"))]
    optional = []
    if lead:
        optional.append(F.when(first, F.struct((home - 1).alias("_chunk"), F.lit(False).alias("_own"))))
    if lag:
        optional.append(F.when(last, F.struct((home + 1).alias("_chunk"), F.lit(False).alias("_own"))))
    spread = df.select("*", F.inline(F.array_compact(F.array(*copies, *optional))))
    w = W.partitionBy(key, "_chunk").orderBy(ord_col)
    new = {out: F.lead(c).over(w) for c, out in lead.items()}
    new.update({out: F.lag(c).over(w) for c, out in lag.items()})
    return spread.withColumns(new).where("_own").drop("_chunk", "_own")


def running_sum(df: DataFrame, key: str, value: str, into: str, ord_col: str = "ord", rows: int = CHUNK_ROWS) -> DataFrame:
    """Inclusive prefix sum of value along the order of each key."""
    chunked = df.withColumn("_chunk", chunk_of(ord_col, rows))
    before = _offsets(chunked, key, F.sum(value))
    w = W.partitionBy(key, "_chunk").orderBy(ord_col).rowsBetween(W.unboundedPreceding, 0)
    inside = chunked.withColumn("_in", F.sum(value).over(w))
    out = inside.join(before, [key, "_chunk"])
    return out.withColumn(into, F.col("_in") + F.col("_before")).drop("_chunk", "_in", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """The k first rows of every key, ranked from 1.

    A key is cut into salted parts that keep k rows each before the final ranking, so
    the last window sees at most salts * k rows per key.
    """
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = part.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k).drop("_salt", "_r")
    outer = W.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def forward_fill(df: DataFrame, cols: list[str], ord_col: str = "ord", keys: list[str] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Replace NULLs by the last value before them in the order (integers from 1)."""
    keys = keys or []
    chunked = df.withColumn("_chunk", chunk_of(ord_col, rows))
    tail = chunked.groupBy(*keys, "_chunk").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ord_col).alias("o"), F.col(c).alias("v")))).alias("_t_" + c) for c in cols])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tail.select(*keys, "_chunk", *[F.last("_t_" + c, ignorenulls=True).over(before).getField("v").alias("_c_" + c) for c in cols])
    inside = W.partitionBy(*keys, "_chunk").orderBy(ord_col).rowsBetween(W.unboundedPreceding, 0)
    filled = chunked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols}).join(carry, [*keys, "_chunk"])
    return filled.withColumns({c: F.coalesce(c, "_c_" + c) for c in cols}).drop("_chunk", *["_c_" + c for c in cols])
