"""Terrain queries: snapping, sampling, meshes, ray hits and shading.

Heights live on lattice vertices (patch, level, gx, gy, value); a tile of a level is an
(n-1) x (n-1) grid of quads whose vertex positions follow from the tile's own corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS
from terrasphere.functions import hits, keys
from terrasphere.functions.descent import choose_path, place_of, ray_descend, refine, with_quad_corners, with_scope
from terrasphere.functions.sphere import cart_to_geodetic
from terrasphere.functions.vec import V3, num, put, ratio
from terrasphere.operators.grid import ancestors
from terrasphere.operators.pyramid import fill_defaults, level_asof, tile_stats
from terrasphere.session import cut_lineage

KEY = ["patch", "level", "path"]


def cell_in_tile(points: DataFrame, n: int) -> DataFrame:
    """Sub-cell (cx, cy) of the tile (patch, level, path) that holds direction p*.

    The descent of the tile goes on for log2(n-1) levels.
    """
    deeper = (n - 1).bit_length() - 1
    sub = choose_path(F.col("patch"), F.col("level"), F.col("path"), V3.of("p"), deeper)
    df = points.withColumn("_sub", sub)
    cx, cy = keys.tile_xy(F.lit(deeper), F.col("_sub"))
    return df.withColumns({"cx": cx, "cy": cy}).drop("_sub")


def extruded(lattice_cells: DataFrame, heights: DataFrame, n: int, vertical_scale=1.0, default=0.0, radius=EARTH_RADIUS) -> DataFrame:
    """Surface vertices (KEY, i, j, gx, gy, x, y, z, value) of the given tiles.

    heights: patch, level, gx, gy, value; nodata takes the default height.
    """
    cells = lattice_cells.select(*KEY).distinct()
    v = refine(with_scope(cells), n, KEY, radius)
    tx, ty = keys.tile_xy(F.col("level"), F.col("path"))
    v = v.withColumns({"gx": tx * (n - 1) + F.col("i"), "gy": ty * (n - 1) + F.col("j")})
    v = v.join(heights.select("patch", "level", "gx", "gy", "value"), ["patch", "level", "gx", "gy"], "left")
    h = fill_defaults(F.col("value"), float(default)) * num(vertical_scale)
    grown = V3.of("") * (1 + h / num(radius))
    return put(v.withColumn("_h", h), **{"": grown}).drop("_h")


def quads(vertices: DataFrame, n: int, payload: list[str] = ("x", "y", "z")) -> DataFrame:
    """One row per quad (KEY, cx, cy) with v0..v3 = lower left, lower right, upper left, upper right.

    Each vertex goes to its up to four quads and is put in place by a conditional
    aggregate: one shuffle, no self-joins.
    """
    size = n - 1
    spots = F.array(*[
        F.when((F.col("i") - di).between(0, size - 1) & (F.col("j") - dj).between(0, size - 1),
               F.struct((F.col("i") - di).alias("cx"), (F.col("j") - dj).alias("cy"), F.lit(di + 2 * dj).alias("_c")))
        for dj in (0, 1) for di in (0, 1)])
    spread = vertices.select(*KEY, *payload, F.inline(F.array_compact(spots)))
    return spread.groupBy(*KEY, "cx", "cy").agg(*[
        F.max(F.when(F.col("_c") == k, F.col(p))).alias(f"v{k}{p}") for k in range(4) for p in payload])


def quads_at(cells: DataFrame, heights: DataFrame, n: int, vertical_scale=1.0, default=0.0, radius=EARTH_RADIUS) -> DataFrame:
    """quads() of the given (KEY, cx, cy) alone: four vertices a quad, whatever the size of its tile's grid."""
    own = with_quad_corners(cells.select(*KEY, "cx", "cy").distinct(), n)
    tx, ty = keys.tile_xy(F.col("level"), F.col("path"))
    own = own.withColumns({"_tx": tx * (n - 1) + F.col("cx"), "_ty": ty * (n - 1) + F.col("cy")})
    corner = F.array(*[F.struct(F.lit(k).alias("_c"), (F.col("_tx") + k % 2).alias("gx"), (F.col("_ty") + k // 2).alias("gy"), *V3.of(f"c{k}").cols("")) for k in range(4)])
    v = own.select(*KEY, "cx", "cy", F.inline(corner)).join(heights.select("patch", "level", "gx", "gy", "value"), ["patch", "level", "gx", "gy"], "left")
    h = fill_defaults(F.col("value"), float(default)) * num(vertical_scale)
    v = put(v.withColumn("_h", h), **{"": V3.of("") * num(radius) * (1 + F.col("_h") / num(radius))})
    return v.groupBy(*KEY, "cx", "cy").agg(*[F.max(F.when(F.col("_c") == k, F.col(a))).alias(f"v{k}{a}") for k in range(4) for a in "xyz"])


def mesh(quad_rows: DataFrame) -> DataFrame:
    """Two triangles per quad: (0, 3, 2) and (0, 1, 3)."""
    def tri(k, corners):
        cols = [F.col(f"v{c}{a}").alias(f"t{i}{a}") for i, c in enumerate(corners) for a in "xyz"]
        return F.struct(F.lit(k).alias("triangle"), *cols)
    return quad_rows.select(*KEY, "cx", "cy", F.inline(F.array(tri(0, (0, 3, 2)), tri(1, (0, 1, 3)))))


def snap(points: DataFrame, heights: DataFrame, n: int, key: list[str], offset=0.0, vertical_scale=1.0, default=0.0,
         radius=EARTH_RADIUS) -> DataFrame:
    """Surface point straight below or above each point (p*, with its finest tile KEY).

    The quad's triangles are hit from p towards the centre; if rounding misses both, the
    height of the lower left vertex is used.
    """
    located = cut_lineage(cell_in_tile(points, n))  # read by the quads and by the join with them
    q = quads_at(located, heights.withColumn("value", F.coalesce("value", F.lit(float(default))) + offset), n, vertical_scale, default + offset, radius)
    p = V3.of("p")
    df = located.join(q, [*KEY, "cx", "cy"])
    df = put(df, d=-(p.unit()))
    v = [V3.of(f"v{k}") for k in range(4)]
    df = df.withColumns({"_t0": hits.ray_triangle(p, V3.of("d"), v[0], v[3], v[2]), "_t1": hits.ray_triangle(p, V3.of("d"), v[0], v[1], v[3])})
    t = F.coalesce("_t0", "_t1")
    fallback = p * ratio(v[0].norm(), p.norm())
    hit = p + V3.of("d") * t
    out = V3(F.coalesce(hit.x, fallback.x), F.coalesce(hit.y, fallback.y), F.coalesce(hit.z, fallback.z))
    return put(df, s=out).select(*key, *KEY, "cx", "cy", "sx", "sy", "sz")


def lattice_position(points: DataFrame, n: int, level: int, extra_levels: int = 20) -> DataFrame:
    """Continuous lattice position fx, fy of directions p* on a level: the middle of a cell extra_levels below a quad."""
    deep = level + (n - 1).bit_length() - 1 + extra_levels
    df = points.withColumn("_at", place_of(V3.of("p"), deep))
    scale = float(n - 1) * 2.0**level / 2.0**deep
    return df.select(*points.columns, F.col("_at.patch").alias("patch"), F.lit(level).alias("level"),
                     ((F.col("_at.ix") + 0.5) * scale).alias("fx"), ((F.col("_at.iy") + 0.5) * scale).alias("fy"))


def stored_tiles(heights: DataFrame, n: int) -> DataFrame:
    """Tiles that are stored themselves: those with a vertex (of any value) inside their border."""
    size = n - 1
    inner = heights.where((F.col("gx") % size != 0) & (F.col("gy") % size != 0))
    tx, ty = F.floor(F.col("gx") / size).cast("bigint"), F.floor(F.col("gy") / size).cast("bigint")
    return inner.select("patch", "level", keys.path_of_tile(F.col("level"), tx, ty).alias("path")).distinct()


def with_finest(points: DataFrame, tiles: DataFrame, key: list[str], level: int) -> DataFrame:
    """Points (p*) with the finest stored tile (KEY) that holds them, down to a level; points over no tile go."""
    from terrasphere.operators.grid import with_cell

    cells = with_cell(points.select(*key, "px", "py", "pz"), V3.of("p"), level)
    found = level_asof(cells, tiles.select(*KEY), key)
    own = found.select(*key, "patch", F.col("found_level").alias("level"), keys.ancestor_path(F.col("path"), F.col("found_level")).alias("path"))
    return points.join(own, key)


def cell_exit(o: V3, d: V3, t_in: Column) -> tuple[Column, Column]:
    """(exit parameter, side) of a ray from the cell with side sections s0..s3 (top, left, bottom, right)."""
    ts = [hits.ray_plane(o, d, hits.Section.of(f"s{k}")) for k in range(4)]
    ok = [F.when(t >= t_in, t) for t in ts]
    first = F.least(*ok)
    # on a tie the later side wins
    which = F.when(ok[3] == first, 3).when(ok[2] == first, 2).when(ok[1] == first, 1).when(ok[0] == first, 0)
    return first, which


QUAD_SIDE = 0.8  # radians: no side of a base patch is longer, with some room for uneven halves


def in_shell(o: V3, d: V3, lo: Column, hi: Column, quad: Column, radius: float) -> Column:
    """Can a ray hit, between t_in and t_out, quads whose vertices lie between the heights lo and hi?

    A flat quad of an angle dips below its vertices by the cosine, and it may lean out of its cell by a quad: the
    ray's way is taken longer by what it needs for that at its steepest.
    """
    top = num(radius) + hi
    floor = F.greatest((num(radius) + lo) * F.cos(F.least(quad * 2, F.lit(1.5))), F.lit(0.0))
    centre = V3(0.0, 0.0, 0.0)
    t0, t1 = hits.ray_sphere_both(o, d, centre, top)
    s0, s1 = hits.ray_sphere_both(o, d, centre, floor)
    miss = o.cross(d).norm() / d.norm()  # distance of the ray's line from the centre
    more = top * quad * F.greatest(F.try_divide(top, miss), F.lit(1.0)) / d.norm()
    first, last = F.col("t_in") - more, F.col("t_out") + more
    under = F.coalesce((first > s0) & (last < s1), F.lit(False))
    return t0.isNotNull() & (t1 >= first) & (t0 <= last) & ~under


def intersect(rays: DataFrame, heights: DataFrame, n: int, key: str = "ray_id", vertical_scale: float = 1.0, default: float = 0.0,
              radius: float = EARTH_RADIUS, ranges: DataFrame | None = None) -> DataFrame:
    """First terrain hit of each ray (o*, d*): t, hit position, tile and quad.

    ranges are value ranges of all tiles with their descendants, as a store keeps them; without
    them they are computed from the heights.

    The frontier of (ray, cell) rows descends level by level; a step is a narrow kernel
    (children whose sides and elevation shell the ray meets) and an equi-join with the
    stored tiles. Where a child is not stored, its quadrant of the parent is searched in
    the parent's own grid, so tiles of any mix of levels count, each where nothing finer is
    stored. Cells that a ray passes below or above the shell are left at every step, so a ray
    through the globe keeps those near its ends. Quads are tested as triangles and the nearest hit kept by aggregation.
    """
    vs = float(vertical_scale)
    stats = (tile_stats(heights, n) if ranges is None else ranges).select(*KEY, F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"))
    own = stored_tiles(heights, n).withColumn("_own", F.lit(True))
    tree = ancestors(own.select(*KEY)).select(*KEY).distinct().join(own, KEY, "left")
    # a tile without values of its own still spans the default height
    tree = cut_lineage(tree.join(stats, KEY, "left").withColumn("_own", F.coalesce("_own", F.lit(False))))
    depth = tree.agg(F.max("level")).first()[0]
    vec = [f"{v}{a}" for v in "od" for a in "xyz"]
    if depth is None:
        return rays.select(key, *[F.lit(None).cast("double").alias(c) for c in ("t", "hx", "hy", "hz")]).where(F.lit(False))
    deeper = (n - 1).bit_length() - 1
    # _sl: level of the finest stored tile above a cell, with the range of that tile; _bare: nothing finer is stored below
    none = F.lit(None).cast("double")
    rays = rays.select(key, *vec, F.lit(-1).alias("_sl"), F.lit(False).alias("_bare"), none.alias("_slo"), none.alias("_shi"))
    carried = [key, "_sl", "_bare", "_slo", "_shi"]
    frontier = ray_descend(rays, carried, 0)
    parts = []
    for level in range(depth + deeper + 1):
        here = frontier.join(tree.where(F.col("level") == level), KEY, "left") if level <= depth else frontier.withColumns(
            {"_own": F.lit(None).cast("boolean"), "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
        gone = F.col("_bare") | F.col("_own").isNull()
        mine = ~gone & F.col("_own")
        low, high = F.least(F.coalesce("_lo", F.lit(default)), F.lit(default)), F.greatest(F.coalesce("_hi", F.lit(default)), F.lit(default))
        here = here.withColumns({
            "_slo": F.when(mine, low).otherwise(F.col("_slo")), "_shi": F.when(mine, high).otherwise(F.col("_shi")),
            "_sl": F.when(mine, F.lit(level)).otherwise(F.col("_sl")), "_bare": gone, "_lo": F.when(~gone, low), "_hi": F.when(~gone, high)})
        # quads of the stored tile above show where no finer one is stored
        ends = [f(F.least("_lo", "_slo") * vs, F.greatest("_hi", "_shi") * vs) for f in (F.least, F.greatest)]
        coarsest = F.when(F.col("_sl") >= 0, F.col("_sl")).otherwise(F.lit(level))
        meets = in_shell(V3.of("o"), V3.of("d"), *ends, F.lit(QUAD_SIDE / (n - 1)) / F.pow(F.lit(2.0), coarsest.cast("double")), radius)
        here = here.where((~F.col("_bare") | (F.col("_sl") >= 0)) & meets).drop("_lo", "_hi", "_own")
        if level < deeper:
            frontier = ray_descend(here, carried, level + 1)
            continue
        # quads of the tile's own grid that the ray is over
        if level % 2 == 0:
            here = cut_lineage(here)
        at = F.col("_sl") + deeper
        done = F.col("_bare") & (F.lit(level) >= at)
        grid = keys.ancestor_path(F.col("path"), at)
        cx, cy = keys.tile_xy(F.lit(deeper), keys.shr(grid, 2 * F.col("_sl")))
        parts.append(here.where(done).select(key, *vec, "patch", F.col("_sl").alias("level"), keys.ancestor_path(F.col("path"), F.col("_sl")).alias("path"), cx.alias("_cx"), cy.alias("_cy")))
        if level < depth + deeper:
            frontier = ray_descend(here.where(~done), carried, level + 1)
    cand = parts[0]
    for part in parts[1:]:
        cand = cand.unionByName(part)
    # extruded quads lean away from the sphere grid by less than one cell
    offs = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    cand = cand.withColumn("cx", F.explode(F.transform(offs, lambda i: F.col("_cx") + i))).withColumn(
        "cy", F.explode(F.transform(offs, lambda i: F.col("_cy") + i))).drop("_cx", "_cy").distinct()
    # a neighbour may lie in a quadrant that a stored child replaces
    half = 1 << (deeper - 1)
    quadrant = F.when(F.col("cx") >= half, 1).otherwise(0) + F.when(F.col("cy") >= half, 2).otherwise(0)
    below = keys.child(F.col("level"), F.col("path"), quadrant)[1]
    finer = tree.where("_own").select("patch", F.col("level").alias("_l"), F.col("path").alias("_p"))
    cand = cand.withColumns({"_l": (F.col("level") + 1).cast("int"), "_p": below}).join(finer, ["patch", "_l", "_p"], "left_anti").drop("_l", "_p")
    cand = cut_lineage(cand)
    inside = F.col("cx").between(0, n - 2) & F.col("cy").between(0, n - 2)
    q = quads_at(cand.where(inside), heights, n, vs, default, radius)
    tri = cand.join(q, [*KEY, "cx", "cy"])
    v = [V3.of(f"v{k}") for k in range(4)]
    o, d = V3.of("o"), V3.of("d")
    tri = tri.withColumns({"_a": hits.ray_triangle(o, d, v[0], v[3], v[2]), "_b": hits.ray_triangle(o, d, v[0], v[1], v[3])})
    tri = tri.withColumn("t", F.least("_a", "_b")).where(F.col("t") >= 0)
    best = tri.groupBy(key).agg(F.min_by(F.struct("t", *KEY, "cx", "cy", *vec), "t").alias("_b")).select(key, "_b.*")
    return put(best, h=V3.of("o") + V3.of("d") * F.col("t")).select(key, "t", "hx", "hy", "hz", *KEY, "cx", "cy")


def normals(vertices: DataFrame, n: int) -> DataFrame:
    """Unit normals cross(right - left, up - down) per tile vertex (KEY, i, j, x, y, z), edges clamped.

    Every vertex is sent to the four neighbours it is a neighbour of; at an edge it also
    stands in for the missing one.
    """
    top = n - 1
    i, j = F.col("i"), F.col("j")
    def to(di, dj, role):
        ok = (i + di).between(0, top) & (j + dj).between(0, top)
        return F.when(ok, F.struct((i + di).alias("i"), (j + dj).alias("j"), F.lit(role).alias("_r")))
    def own(cond, role):
        return F.when(cond, F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("_r")))
    roles = F.array(to(-1, 0, "r"), to(1, 0, "l"), to(0, -1, "u"), to(0, 1, "d"),
                    own(i == top, "r"), own(i == 0, "l"), own(j == top, "u"), own(j == 0, "d"))
    spread = vertices.select(*KEY, "x", "y", "z", F.inline(F.array_compact(roles)))
    g = spread.groupBy(*KEY, "i", "j").agg(*[
        F.max(F.when(F.col("_r") == r, F.col(a))).alias(r + a) for r in "rlud" for a in "xyz"])
    m = (V3.of("r") - V3.of("l")).cross(V3.of("u") - V3.of("d"))
    return put(put(g, m=m), n=V3.of("m").unit()).select(*KEY, "i", "j", "nx", "ny", "nz")


def sun_vector(azimuth_deg, elevation_deg) -> V3:
    az, el = F.radians(num(azimuth_deg)), F.radians(num(elevation_deg))
    return V3(F.sin(az) * F.cos(el), F.cos(az) * F.cos(el), F.sin(el))


def hillshade(n: V3, azimuth_deg, elevation_deg, ambient=0.2, diffuse=0.8, specular=0.0, shininess=55.0, view: V3 | None = None) -> Column:
    """Ambient plus diffuse plus specular light of a distant source, per unit normal."""
    sun = sun_vector(azimuth_deg, elevation_deg)
    nl = F.greatest(n.dot(sun), F.lit(0.0))
    out = num(ambient) + num(diffuse) * nl
    if view is not None and specular:
        half = (sun + view).unit()
        shine = F.when(nl > 0, F.pow(F.greatest(n.dot(half), F.lit(0.0)), num(shininess))).otherwise(F.lit(0.0))
        out = out + num(specular) * shine
    return out


def probe_range(samples: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (key, range_min, range_max) driven by probe samples (key, probe, num_samples, sample_id, value).

    The last probe of a key counts: one sample shifts the range, of two the first sets
    the minimum and the second the maximum; nodata is ignored.
    """
    s = samples.where(F.col("value").isNotNull())
    last = s.groupBy(key).agg(F.max("probe").alias("probe"))
    use = s.join(last, [key, "probe"])
    single = (F.col("num_samples") == 1)
    agg = use.groupBy(key).agg(
        F.max_by("value", F.when(single, F.col("probe"))).alias("_shift"),
        F.max(F.when(~single & (F.col("sample_id") == 1), F.col("value"))).alias("_lo"),
        F.max(F.when(~single & (F.col("sample_id") != 1), F.col("value"))).alias("_hi"))
    r = ranges.join(agg, key, "left")
    moved = F.col("_shift").isNotNull()
    return r.select(
        key, F.when(moved, F.col("_shift")).otherwise(F.coalesce("_lo", "range_min")).alias("range_min"),
        F.when(moved, F.col("range_max") + F.col("_shift") - F.col("range_min")).otherwise(F.coalesce("_hi", "range_max")).alias("range_max"))


def to_lonlat_elev(p: V3, vertical_scale=1.0, radius=EARTH_RADIUS) -> tuple[Column, Column, Column]:
    """Read-out of a point on the vertically scaled globe: degrees and true elevation."""
    lon, lat, _ = cart_to_geodetic(p, radius)
    return lon, lat, ratio(p.norm() - num(radius), num(vertical_scale))
