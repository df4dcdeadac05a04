"""Views over the driver's tables that the registered queries run on (FIXTURES.md).

Every text runs unchanged in Spark and in DuckDB. All of them read whole tables and
grow with them, except the small dimensions (palette, layers, symbols).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

LATTICE_LEVEL = 8
LATTICE_N = 17
TERRAIN_LEVEL = 2


def _tile(k: str, at: int) -> str:
    bits = range(LATTICE_LEVEL)
    if at == 0:
        return " + ".join(f"(CAST(floor({k} / {4**i}) AS BIGINT) % 2) * {2**i}" for i in bits)
    return " + ".join(f"(CAST(floor({k} / {2 * 4**i}) AS BIGINT) % 2) * {2**i}" for i in bits)


VIEWS: dict[str, str] = {
    "geo_points": """
        SELECT event_id AS point_id, ts, user_id,
          CAST((event_id*7919)%36000 AS DOUBLE)/CAST(100 AS DOUBLE)-180 AS lon_deg,
          CAST((event_id*104729)%17801 AS DOUBLE)/CAST(100 AS DOUBLE)-89 AS lat_deg, value AS elev
        FROM events""",
    "point_pairs": """
        SELECT event_id AS point_id,
          CAST((event_id*7919)%36000 AS DOUBLE)/CAST(100 AS DOUBLE)-180 AS lon_deg,
          CAST((event_id*104729)%17801 AS DOUBLE)/CAST(100 AS DOUBLE)-89 AS lat_deg,
          CAST((event_id*4373+user_id)%36000 AS DOUBLE)/CAST(100 AS DOUBLE)-180 AS lon2_deg,
          CAST((event_id*6571+user_id)%17801 AS DOUBLE)/CAST(100 AS DOUBLE)-89 AS lat2_deg, value AS elev
        FROM events""",
    "images": """
        SELECT CAST(s_suppkey AS BIGINT) AS image_id, CAST(s_suppkey AS BIGINT) AS ord,
          CAST((s_suppkey*37)%336-170 AS DOUBLE)+CAST(s_suppkey%3 AS DOUBLE)/8 AS gt0, CAST(1 AS DOUBLE)/2 AS gt1, CAST(0 AS DOUBLE) AS gt2,
          CAST((s_suppkey*53)%130-50 AS DOUBLE) AS gt3, CAST(0 AS DOUBLE) AS gt4, -CAST(1 AS DOUBLE)/2 AS gt5,
          24 AS size_x, 24 AS size_y, CAST(s_suppkey%4 AS DOUBLE)*10 AS px_offset,
          CAST(1+s_suppkey%4 AS DOUBLE) AS px_scale, CAST(1 AS DOUBLE) AS nodata, s_suppkey%2=1 AS point_sampled
        FROM supplier""",
    "pixels": """
        SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(l_partkey%24 AS INTEGER) AS px,
          CAST(l_orderkey%24 AS INTEGER) AS py, min(l_quantity) AS value
        FROM lineitem GROUP BY 1,2,3""",
    "rgb_pixels": """
        SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(l_partkey%24 AS INTEGER) AS px,
          CAST(l_orderkey%24 AS INTEGER) AS py, CAST(min(l_quantity)*5 AS INTEGER) AS b1,
          CAST(CASE WHEN l_suppkey%3=0 THEN NULL ELSE max(l_quantity)*4 END AS INTEGER) AS b2,
          CAST(CASE WHEN l_suppkey%3<2 THEN NULL ELSE min(l_linenumber)*9 END AS INTEGER) AS b3
        FROM lineitem GROUP BY 1,2,3,l_suppkey""",
    "lattice": f"""
        SELECT patch, {LATTICE_LEVEL} AS level, gx, gy, CASE WHEN min(v)=1 THEN NULL ELSE min(v) END AS value FROM (
          SELECT CAST(l_suppkey%30 AS INTEGER) AS patch,
            CAST(({_tile('floor(l_suppkey/30)', 0)})*{LATTICE_N - 1} + l_partkey%{LATTICE_N} AS BIGINT) AS gx,
            CAST(({_tile('floor(l_suppkey/30)', 1)})*{LATTICE_N - 1} + l_orderkey%{LATTICE_N} AS BIGINT) AS gy,
            l_quantity AS v
          FROM lineitem) t GROUP BY patch, gx, gy""",
    "terrain": f"""
        SELECT CAST(l_suppkey%30 AS INTEGER) AS patch, {TERRAIN_LEVEL} AS level, CAST(l_partkey%65 AS BIGINT) AS gx,
          CAST(l_orderkey%65 AS BIGINT) AS gy,
          CASE WHEN min(l_quantity)=1 THEN NULL ELSE min(l_quantity)*1000 END AS value
        FROM lineitem GROUP BY 1,3,4""",
    # the terrain and, over a third of the patches, about half of the tiles of the next finer level
    "terrain_mixed": f"""
        SELECT CAST(l_suppkey%30 AS INTEGER) AS patch, {TERRAIN_LEVEL} AS level, CAST(l_partkey%65 AS BIGINT) AS gx,
          CAST(l_orderkey%65 AS BIGINT) AS gy,
          CASE WHEN min(l_quantity)=1 THEN NULL ELSE min(l_quantity)*1000 END AS value
        FROM lineitem GROUP BY 1,3,4
        UNION ALL SELECT CAST(l_suppkey%30 AS INTEGER) AS patch, {TERRAIN_LEVEL + 1} AS level, CAST(l_partkey%129 AS BIGINT) AS gx,
          CAST(l_orderkey%129 AS BIGINT) AS gy,
          CASE WHEN min(l_quantity)=1 THEN NULL ELSE min(l_quantity)*1500 END AS value
        FROM lineitem WHERE l_suppkey%3=0 AND l_partkey%129%16<>0 AND l_orderkey%129%16<>0
          AND (CAST(floor(l_partkey%129/16) AS BIGINT)*3+CAST(floor(l_orderkey%129/16) AS BIGINT)*5)%4<2 GROUP BY 1,3,4""",
    "line_points": """
        SELECT o_custkey AS line_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey) AS BIGINT) AS ord,
          CAST((o_custkey*37)%340 AS DOUBLE)-170+CAST(o_orderkey%100 AS DOUBLE)/CAST(10 AS DOUBLE) AS lon_deg,
          CAST((o_custkey*53)%160 AS DOUBLE)-80+CAST((o_orderkey*7)%100 AS DOUBLE)/CAST(20 AS DOUBLE) AS lat_deg,
          CAST(o_orderkey%500 AS DOUBLE) AS elev, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS symbol_id,
          o_orderdate AS stamp
        FROM orders""",
    "line_edits": """
        SELECT event_id AS edit_id, ts AS edit_ts, user_id AS line_id,
          CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'add_front' WHEN 'click' THEN 'add_back' ELSE 'move' END AS op,
          CAST((event_id*7919)%36000 AS DOUBLE)/CAST(100 AS DOUBLE)-180 AS lon_deg,
          CAST((event_id*104729)%17801 AS DOUBLE)/CAST(100 AS DOUBLE)-89 AS lat_deg
        FROM events""",
    "palette": """
        SELECT CAST(value AS DOUBLE) AS value, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b,
          CAST(a AS DOUBLE) AS a
        FROM (VALUES (0.0,0.0,0.0,0.5,1.0),(10.0,0.0,0.5,0.25,1.0),(25.0,0.5,0.75,0.0,1.0),(40.0,1.0,0.5,0.0,0.5),(50.0,1.0,1.0,1.0,1.0)) AS p(value,r,g,b,a)""",
    "symbols": """
        SELECT DISTINCT CAST(substr(o_orderpriority,1,1) AS INTEGER) AS symbol_id, substr(o_orderpriority,3) AS symbol_name
        FROM orders WHERE substr(o_orderpriority,1,1)<>'5'""",
    "views": """
        SELECT CAST(s_suppkey AS BIGINT) AS view_id, CAST((s_suppkey*61)%360 AS DOUBLE)-180 AS eye_lon_deg,
          CAST((s_suppkey*29)%170 AS DOUBLE)-85 AS eye_lat_deg, CAST(6371000 AS DOUBLE)*2 AS eye_r,
          CAST(1000000 AS DOUBLE) AS focus_radius
        FROM supplier""",
    "layers": """
        SELECT r_regionkey AS layer_id, r_name AS layer_name,
          CASE WHEN r_regionkey=0 THEN 'dem' WHEN r_regionkey<3 THEN 'color' ELSE 'layerf' END AS layer_kind,
          r_regionkey<>4 AS visible, r_regionkey%2=0 AS clamped
        FROM region""",
    # concave L, box or triangle in degrees, one per supplier
    "polygons": """
        SELECT CAST(s_suppkey AS BIGINT) AS poly_id, v.ord AS ord,
          CAST((s_suppkey*41)%340-175 AS DOUBLE)+v.x AS x, CAST((s_suppkey*59)%150-80 AS DOUBLE)+v.y AS y
        FROM supplier JOIN (VALUES
          (0,0,CAST(0 AS DOUBLE),CAST(0 AS DOUBLE)),(0,1,CAST(10 AS DOUBLE),CAST(0 AS DOUBLE)),(0,2,CAST(10 AS DOUBLE),CAST(4 AS DOUBLE)),
          (0,3,CAST(4 AS DOUBLE),CAST(4 AS DOUBLE)),(0,4,CAST(4 AS DOUBLE),CAST(9 AS DOUBLE)),(0,5,CAST(0 AS DOUBLE),CAST(9 AS DOUBLE)),
          (1,0,CAST(0 AS DOUBLE),CAST(0 AS DOUBLE)),(1,1,CAST(8 AS DOUBLE),CAST(0 AS DOUBLE)),(1,2,CAST(8 AS DOUBLE),CAST(6 AS DOUBLE)),
          (1,3,CAST(0 AS DOUBLE),CAST(6 AS DOUBLE)),
          (2,0,CAST(1 AS DOUBLE),CAST(0 AS DOUBLE)),(2,1,CAST(11 AS DOUBLE),CAST(2 AS DOUBLE)),(2,2,CAST(3 AS DOUBLE),CAST(8 AS DOUBLE))
        ) AS v(shape,ord,x,y) ON s_suppkey%3=v.shape""",
    # a bent fault line of 25 control points
    "fault_points": """
        SELECT CAST(n_nationkey AS BIGINT)+1 AS ord, CAST(-60+5*n_nationkey AS DOUBLE) AS lon_deg,
          CAST((n_nationkey*7)%11-5 AS DOUBLE) AS lat_deg, CAST(n_nationkey*10 AS DOUBLE) AS elev
        FROM nation""",
}


def load_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        spark.read.parquet(path).createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame; line order is computed safely for hot lines."""
    needed = [t for t in TABLES if f" {t}" in VIEWS[name].replace("\n", " ")]
    for t in needed:
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(t)
    if name == "line_points":
        return _line_points(spark)
    return spark.sql(VIEWS[name])


def _line_points(spark: SparkSession) -> DataFrame:
    from terrasphere.operators.ordered import dense_order

    raw = spark.sql(
        VIEWS["line_points"].replace(
            "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey) AS BIGINT) AS ord", "o_orderkey"
        )
    )
    out = dense_order(raw, "line_id", ["stamp", "o_orderkey"], chunk="stamp", into="ord")
    return out.select("line_id", "ord", "lon_deg", "lat_deg", "elev", "symbol_id", "stamp")


def with_clause(names: str, *extra: str, recursive: bool = False) -> str:
    """WITH clause of fixture views (and further named texts) for an oracle query."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split()] + list(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
