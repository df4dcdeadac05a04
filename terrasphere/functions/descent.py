"""Vectorised cell descent. Each level halves four great-circle sides, so there is no
closed form; numpy over Arrow batches was 15x faster than a native fold on 100,000
points at level 12 (0.45 s against 6.7 s, 8 cores)."""

from __future__ import annotations

from collections.abc import Iterator

import sys
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.functions.patches import ROOT_CORNERS, SIDE_NORMALS
from terrasphere.functions.vec import V3

# the kernels travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCOPE_NAMES = [f"c{c}{a}" for c in range(4) for a in "xyz"]
SCOPE_TYPE = ", ".join(f"{n} double" for n in SCOPE_NAMES)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def split_points(c: np.ndarray):
    """Midpoints of top, left, bottom, right and the middle of scopes (N, 4, 3)."""
    top, left = unit(c[:, 3] + c[:, 2]), unit(c[:, 2] + c[:, 0])
    bottom, right = unit(c[:, 0] + c[:, 1]), unit(c[:, 1] + c[:, 3])
    return top, left, bottom, right, unit(top + bottom)


def enter(c: np.ndarray, which: np.ndarray, middle: np.ndarray | None = None) -> np.ndarray:
    """Scope of the chosen child of every row. The lattice of a tile has middles of its own."""
    top, left, bottom, right, mid = split_points(c)
    mid = mid if middle is None else middle
    # 3x3 lattice of the split scope, addressed by (row, column)
    grid = np.stack([c[:, 0], bottom, c[:, 1], left, mid, right, c[:, 2], top, c[:, 3]], 1)
    base = (which >> 1) * 3 + (which & 1)
    idx = base[:, None] + np.array([0, 1, 3, 4])[None, :]
    return np.take_along_axis(grid, idx[:, :, None], 1)


def choose(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Child holding p: a bit is set when p lies on the negative side of a mid-plane."""
    vertical = np.cross(c[:, 0] + c[:, 1], c[:, 2] + c[:, 3])
    horizontal = np.cross(c[:, 1] + c[:, 3], c[:, 0] + c[:, 2])
    return ((vertical * p).sum(1) < 0).astype(np.int64) + 2 * ((horizontal * p).sum(1) < 0)


def choose_fine(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """choose() from differences of near vectors: exact where cells are too small for their cross products."""
    def beyond(a, b):
        a, b = a / 2, b / 2
        return (np.cross(a, b - a) * (p - a)).sum(1) < 0

    return beyond(c[:, 0] + c[:, 1], c[:, 2] + c[:, 3]).astype(np.int64) + 2 * beyond(c[:, 1] + c[:, 3], c[:, 0] + c[:, 2])


def locate(patch: np.ndarray, p: np.ndarray, levels: np.ndarray) -> np.ndarray:
    c = ROOT_CORNERS[patch]
    path = np.zeros(len(patch), np.int64)
    for k in range(int(levels.max(initial=0))):
        which = choose(c, p)
        path |= np.where(levels > k, which << (2 * k), 0)
        c = enter(c, which)
    return path


def scopes(patch: np.ndarray, level: np.ndarray, path: np.ndarray) -> np.ndarray:
    c = ROOT_CORNERS[patch]
    for k in range(int(level.max(initial=0))):
        go = level > k
        c = np.where(go[:, None, None], enter(c, (path >> (2 * k)) & 3), c)
    return c


def refine_block(c: np.ndarray, n: int) -> np.ndarray:
    """(N, n, n, 3) lattice of scopes by recursive midpoints; axis 1 is y, axis 2 is x."""
    out = np.empty((len(c), n, n, 3))
    out[:, 0, 0], out[:, 0, -1], out[:, -1, 0], out[:, -1, -1] = c[:, 0], c[:, 1], c[:, 2], c[:, 3]
    size = n - 1
    while size > 1:
        h = size // 2
        ll, lr = out[:, 0:-1:size, 0:-1:size], out[:, 0:-1:size, size::size]
        ul, ur = out[:, size::size, 0:-1:size], out[:, size::size, size::size]
        middle = unit(ll + lr + ul + ur)
        out[:, 0::size, h::size] = unit(out[:, 0::size, 0:-1:size] + out[:, 0::size, size::size])
        out[:, h::size, 0::size] = unit(out[:, 0:-1:size, 0::size] + out[:, size::size, 0::size])
        out[:, h::size, h::size] = middle
        size = h
    return out


def patch_index(p: np.ndarray) -> np.ndarray:
    """Base patch of directions (N, 3): the lowest patch with all four half-space tests
    passed, or the nearest one where rounding leaves a point just outside every patch."""
    margin = np.einsum("nk,psk->nps", p, SIDE_NORMALS).min(2)
    inside = margin >= 0
    return np.where(inside.any(1), inside.argmax(1), margin.argmax(1))


def _points(x: pd.Series, y: pd.Series, z: pd.Series) -> np.ndarray:
    return np.stack([x.to_numpy(), y.to_numpy(), z.to_numpy()], 1)


def _patches(p: np.ndarray) -> np.ndarray:
    if len(p) == 0:
        return np.zeros(0, np.int64)
    return np.concatenate([patch_index(p[i : i + 8192]) for i in range(0, len(p), 8192)])


def boundary(c: np.ndarray, subdivisions: int) -> np.ndarray:
    """(N, 4 * 2^k, 2) lon/lat vertices along bottom, right, top and left of scopes."""
    k = 1 << subdivisions
    sides = []
    for i, j in ((0, 1), (1, 3), (3, 2), (2, 0)):
        line = np.empty((len(c), k + 1, 3))
        line[:, 0], line[:, -1] = c[:, i], c[:, j]
        size = k
        while size > 1:
            line[:, size // 2 :: size] = unit(line[:, 0:-1:size] + line[:, size::size])
            size //= 2
        sides.append(line[:, :-1])
    v = np.concatenate(sides, 1)
    return np.stack([np.arctan2(v[..., 1], v[..., 0]), np.arcsin(np.clip(v[..., 2], -1, 1))], -1)


def unwrap(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (N, m, 2) with near consecutive longitudes, at most pi at the eastern end, and which vertices
    lie at a pole. Such a vertex takes the longitude before it."""
    v = v.copy()
    pole = np.abs(np.pi / 2 - np.abs(v[..., 1])) < 1e-5
    for k in range(1, v.shape[1]):
        lon, before = np.where(pole[:, k], v[:, k - 1, 0], v[:, k, 0]), v[:, k - 1, 0]
        v[:, k, 0] = lon - 2 * np.pi * np.round((lon - before) / (2 * np.pi))
    v[..., 0] -= np.where(v[..., 0].max(1) > np.pi, 2 * np.pi, 0.0)[:, None]
    return v, pole


def flat_rings(v: np.ndarray, pole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices one ring after the other, and how many each has; leaving a pole adds a pole vertex at the
    new longitude."""
    n, m = v.shape[:2]
    ring, k = np.nonzero(pole[:, :-1])
    added = np.stack([v[ring, k + 1, 0], v[ring, k, 1]], 1)
    return np.insert(v.reshape(-1, 2), ring * m + k + 1, added, axis=0), m + np.bincount(ring, minlength=n)


def crosses(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Segments a..b against the four bounded side sections of scopes: entry and exit overlap [0, 1]."""
    d = b - a
    lo, hi = np.full(len(c), np.inf), np.full(len(c), -np.inf)
    for i, j in ((3, 2), (2, 0), (0, 1), (1, 3)):
        s, e = c[:, i], c[:, j]
        n = unit(np.cross(s, e))
        along = e - s
        ta = along - s * ((along * s).sum(1) / (s * s).sum(1))[:, None]
        tb = -along + e * ((along * e).sum(1) / (e * e).sum(1))[:, None]
        nd, no = (n * d).sum(1), (n * a).sum(1)
        flat = np.abs(nd) < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(flat, np.where(np.abs(no) < 1e-12, 0.0, np.nan), -no / nd)
        p = a + d * t[:, None]
        ok = ((ta * p).sum(1) >= 0) & ((tb * p).sum(1) >= 0)
        lo, hi = np.where(ok, np.minimum(lo, t), lo), np.where(ok, np.maximum(hi, t), hi)
    return (hi >= 0) & (lo <= 1)


def near_cap(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cheap necessary test: the caps around the segment's and the cell's directions meet."""
    a, b, mid = unit(a), unit(b), unit(c.sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        m = unit(a + b)
    half = np.arccos(np.clip((a * b).sum(1), -1, 1)) / 2
    reach = np.arccos(np.clip((c * mid[:, None]).sum(2).min(1), -1, 1))
    return ~((m * mid).sum(1) < np.cos(np.minimum(half + reach + 1e-6, np.pi)))


@cache
def _root_caps() -> tuple[np.ndarray, np.ndarray]:
    """Middle direction of every root and the angle to its farthest corner."""
    mid = unit(ROOT_CORNERS.sum(1))
    return mid, np.arccos(np.clip((ROOT_CORNERS * mid[:, None]).sum(2).min(1), -1, 1))


def near_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, root) of the pairs that pass near_cap, without a row for the others."""
    mid, reach = _root_caps()
    a, b = unit(a), unit(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = unit(a + b)
    half = np.arccos(np.clip((a * b).sum(1), -1, 1)) / 2
    return np.nonzero(~(m @ mid.T < np.cos(np.minimum(half[:, None] + reach + 1e-6, np.pi))))


@cache
def _udfs():
    def patch(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(_patches(_points(x, y, z)))

    def cell(x: pd.Series, y: pd.Series, z: pd.Series, level: pd.Series) -> pd.DataFrame:
        p = _points(x, y, z)
        where = _patches(p)
        return pd.DataFrame({"patch": where, "path": locate(where, p, level.to_numpy(np.int64))})

    def below(patch: pd.Series, level: pd.Series, path: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series, deeper: pd.Series) -> pd.Series:
        c = scopes(patch.to_numpy(np.int64), level.to_numpy(np.int64), path.to_numpy(np.int64))
        p, sub = _points(x, y, z), np.zeros(len(c), np.int64)
        for k in range(int(deeper.iloc[0]) if len(c) else 0):
            which = choose(c, p)
            sub |= which << (2 * k)
            c = enter(c, which)
        return pd.Series(sub)

    def place(x: pd.Series, y: pd.Series, z: pd.Series, depth: pd.Series) -> pd.DataFrame:
        p = _points(x, y, z)
        where = _patches(p)
        c = ROOT_CORNERS[where]
        ix, iy = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        for _ in range(int(depth.iloc[0]) if len(depth) else 0):
            which = choose_fine(c, p)
            ix, iy = 2 * ix + (which & 1), 2 * iy + (which >> 1)
            c = enter(c, which)
        return pd.DataFrame({"patch": where, "ix": ix, "iy": iy})

    def quad(patch: pd.Series, level: pd.Series, path: pd.Series, cx: pd.Series, cy: pd.Series, deeper: pd.Series) -> pd.DataFrame:
        c = scopes(patch.to_numpy(np.int64), level.to_numpy(np.int64), path.to_numpy(np.int64))
        x, y = cx.to_numpy(np.int64), cy.to_numpy(np.int64)
        for k in range(int(deeper.iloc[0]) - 1 if len(c) else -1, -1, -1):
            middle = unit(c[:, 0] + c[:, 1] + c[:, 2] + c[:, 3])
            c = enter(c, ((x >> k) & 1) + 2 * ((y >> k) & 1), middle)
        return pd.DataFrame(c.reshape(len(c), 12), columns=SCOPE_NAMES)

    def scope(patch: pd.Series, level: pd.Series, path: pd.Series) -> pd.DataFrame:
        c = scopes(patch.to_numpy(np.int64), level.to_numpy(np.int64), path.to_numpy(np.int64))
        return pd.DataFrame(c.reshape(len(c), 12), columns=SCOPE_NAMES)

    return {
        "patch": F.pandas_udf(patch, "int"),
        "cell": F.pandas_udf(cell, "patch int, path bigint"),
        "scope": F.pandas_udf(scope, SCOPE_TYPE),
        "quad": F.pandas_udf(quad, SCOPE_TYPE),
        "below": F.pandas_udf(below, "bigint"),
        "place": F.pandas_udf(place, "patch int, ix bigint, iy bigint"),
    }


def patch_of(p: V3) -> Column:
    return _udfs()["patch"](p.x, p.y, p.z)


def cell_of(p: V3, level: Column) -> Column:
    """struct<patch, path> of the cell holding p."""
    return _udfs()["cell"](p.x, p.y, p.z, level)


def place_of(p: V3, depth: int) -> Column:
    """struct<patch, ix, iy>: column and row of the cell holding p, 2^depth of them along a side.

    No path is kept, so the depth may pass that of stored cells, up to the bits of a double.
    """
    if depth > 52:
        raise ValueError("a position has at most 52 bits along a side")
    return _udfs()["place"](p.x, p.y, p.z, F.lit(depth))


def choose_path(patch: Column, level: Column, path: Column, p: V3, deeper: int) -> Column:
    """Path of the cell holding p, relative to a cell, a number of levels further down."""
    return _udfs()["below"](patch, level, path, p.x, p.y, p.z, F.lit(deeper))


def span(c: np.ndarray, o: np.ndarray, d: np.ndarray):
    """Ray parameters (enter, leave) inside the wedge of directions of scopes; empty if enter > leave."""
    lo, hi = np.full(len(c), -np.inf), np.full(len(c), np.inf)
    for i, j in ((3, 2), (2, 0), (0, 1), (1, 3)):
        n = unit(np.cross(c[:, i], c[:, j]))
        no, nd = (n * o).sum(1), (n * d).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -no / nd
        flat = np.abs(nd) < 1e-15
        lo = np.where(~flat & (nd > 0), np.maximum(lo, t), lo)
        hi = np.where(~flat & (nd < 0), np.minimum(hi, t), hi)
        hi = np.where(flat & (no < -1e-6), -np.inf, hi)
    return lo, hi


def ray_descend(frontier: DataFrame, keys: list[str], level: int, tile_level: int | None = None) -> DataFrame:
    """Cells of one level whose wedge rays (o*, d*) pass at t >= 0, below their frontier cells.

    Adds t_in, t_out. Below tile_level the split is that of the tile's lattice, which
    differs from the cell hierarchy only in its middle points. Narrow.
    """
    vec = [f"{v}{a}" for v in "od" for a in "xyz"]
    key_type = ", ".join(f.simpleString().replace(":", " ", 1) for f in frontier.select(*keys).schema)
    cell = [] if level == 0 else ["patch", "path"]
    names = [*keys, *vec]
    slack = 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = part.num_rows
                o = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in vec[:3]], 1)
                d = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in vec[3:]], 1)
                if level == 0:
                    row, patch, path = np.repeat(np.arange(m), 30), np.tile(np.arange(30), m), np.zeros(m * 30, np.int64)
                else:
                    row = np.repeat(np.arange(m), 4)
                    patch = part.column("patch").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                    path = part.column("path").to_numpy(zero_copy_only=False)[row] | (np.tile(np.arange(4), m) << (2 * (level - 1)))
                lo, hi = span(scopes(patch, np.full(len(row), level), path), o[row], d[row])
                lo = np.maximum(lo, 0.0)
                ok = lo <= hi + slack * (1 + np.abs(hi))
                take = part.take(pa.array(row[ok]))
                cols = [take.column(k) for k in names]
                cols += [pa.array(patch[ok].astype(np.int32)), pa.array(np.full(int(ok.sum()), level, np.int32)), pa.array(path[ok]),
                         pa.array(lo[ok]), pa.array(hi[ok])]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "patch", "level", "path", "t_in", "t_out"])

    return frontier.select(*names, *cell).mapInArrow(
        run, f"{key_type}, {', '.join(v + ' double' for v in vec)}, patch int, level int, path bigint, t_in double, t_out double")


def with_rings(cells: DataFrame, subdivisions: int) -> DataFrame:
    """Add ring: the boundary of each cell (patch, level, path) as an array of lon, lat. Narrow."""
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                patch, level, path = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("patch", "level", "path"))
                flat, count = flat_rings(*unwrap(boundary(scopes(patch, level, path), subdivisions)))
                vertex = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], ["lon", "lat"])
                off = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(off, vertex).cast(kind)], [*part.schema.names, "ring"])

    schema = ", ".join(f"`{name}` {kind_}" for name, kind_ in cells.dtypes)
    return cells.mapInArrow(run, f"{schema}, ring array<struct<lon: double, lat: double>>")


def box_descend(frontier: DataFrame, keys: list[str], first: int, last: int, subdivisions: int) -> DataFrame:
    """Tiles whose box a lon/lat box (min_lon, min_lat, max_lon, max_lat in radians) meets on any turn, from
    level `first` down to `last` or the row's level `want`.

    Unless first = 0 the frontier carries patch, path of level first - 1. Returned rows have
    reached `want` or `last`. Roots are always entered. Boxes of a batch are tested at once.
    Narrow.
    """
    key_type = ", ".join(f.simpleString().replace(":", " ", 1) for f in frontier.select(*keys).schema)
    sides = ["min_lon", "min_lat", "max_lon", "max_lat"]
    cell = [] if first == 0 else ["patch", "path"]
    names = [*keys, *sides, "want"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                m = part.num_rows
                box = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in sides], 1)
                want = part.column("want").to_numpy(zero_copy_only=False)
                if first == 0:
                    row, patch, path = np.repeat(np.arange(m), 30), np.tile(np.arange(30), m), np.zeros(m * 30, np.int64)
                else:
                    row = np.repeat(np.arange(m), 4)
                    patch = part.column("patch").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                    path = part.column("path").to_numpy(zero_copy_only=False)[row] | (np.tile(np.arange(4), m) << (2 * (first - 1)))
                c = scopes(patch, np.full(len(row), first), path)
                for level in range(first, last + 1):
                    if level > 0 and len(row):
                        v, _ = unwrap(boundary(c, subdivisions))
                        lo, hi, b = v.min(1), v.max(1), box[row]
                        ok = np.zeros(len(row), bool)
                        for turn in (0.0, 2 * np.pi, -2 * np.pi):
                            ok |= (lo[:, 0] + turn <= b[:, 2]) & (hi[:, 0] + turn >= b[:, 0])
                        ok &= (lo[:, 1] <= b[:, 3]) & (hi[:, 1] >= b[:, 1])
                        row, patch, path, c = row[ok], patch[ok], path[ok], c[ok]
                    out = (want[row] == level) | (level == last)
                    take = part.take(pa.array(row[out]))
                    cols = [take.column(k) for k in names]
                    cols += [pa.array(patch[out].astype(np.int32)), pa.array(np.full(int(out.sum()), level, np.int32)), pa.array(path[out])]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "patch", "level", "path"])
                    row, patch, path, c = row[~out], patch[~out], path[~out], c[~out]
                    which = np.tile(np.arange(4), len(row))
                    path, c = np.repeat(path, 4) | (which << (2 * level)), enter(np.repeat(c, 4, axis=0), which)
                    row, patch = np.repeat(row, 4), np.repeat(patch, 4)

    return frontier.select(*names, *cell).mapInArrow(
        run, f"{key_type}, {', '.join(k + ' double' for k in sides)}, want int, patch int, level int, path bigint")


def segment_descend(frontier: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Cells of levels first..last that segments cross, below their frontier cells.

    With first = 0 the frontier has no cells yet and all 30 roots are tried; otherwise
    its rows carry patch, level = first - 1 and path. Narrow: no shuffle.
    """
    vec = [f"{p}{a}" for p in "ab" for a in "xyz"]
    key_type = ", ".join(f.simpleString().replace(":", " ", 1) for f in frontier.select(*keys).schema)
    cell = [] if first == 0 else ["patch", "path"]
    schema = f"{key_type}, {', '.join(v + ' double' for v in vec)}, patch int, level int, path bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m = part.num_rows
                a = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in vec[:3]], 1)
                b = np.stack([part.column(v).to_numpy(zero_copy_only=False) for v in vec[3:]], 1)
                if first == 0:
                    row, patch = near_roots(a, b)
                    path = np.zeros(len(row), np.int64)
                else:
                    row = np.repeat(np.arange(m), 4)
                    patch = part.column("patch").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                    path = part.column("path").to_numpy(zero_copy_only=False)[row] | (np.tile(np.arange(4), m) << (2 * (first - 1)))
                c = scopes(patch, np.full(len(row), first), path)
                for level in range(first, last + 1):
                    ok = near_cap(c, a[row], b[row]) if level else np.ones(len(row), bool)
                    ok[ok] = crosses(c[ok], a[row[ok]], b[row[ok]])
                    row, patch, path, c = row[ok], patch[ok], path[ok], c[ok]
                    take = part.take(pa.array(row))
                    cols = [take.column(k) for k in [*keys, *vec]]
                    cols += [pa.array(patch.astype(np.int32)), pa.array(np.full(len(row), level, np.int32)), pa.array(path)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*keys, *vec, "patch", "level", "path"])
                    if level < last:
                        which = np.tile(np.arange(4), len(row))
                        path, c = np.repeat(path, 4) | (which << (2 * level)), enter(np.repeat(c, 4, axis=0), which)
                        row, patch = np.repeat(row, 4), np.repeat(patch, 4)

    return frontier.select(*keys, *vec, *cell).mapInArrow(run, schema)


def with_scope(cells: DataFrame) -> DataFrame:
    """Add the unit-sphere corners c0x..c3z of (patch, level, path) rows."""
    scope = _udfs()["scope"]("patch", "level", "path")
    return cells.withColumn("_scope", scope).select(*cells.columns, "_scope.*")


def with_quad_corners(cells: DataFrame, n: int) -> DataFrame:
    """Add the unit-sphere corners c0x..c3z of quad (cx, cy) of the n x n lattice of tile (patch, level, path)."""
    corners = _udfs()["quad"]("patch", "level", "path", "cx", "cy", F.lit((n - 1).bit_length() - 1))
    return cells.withColumn("_quad", corners).select(*cells.columns, "_quad.*")


def refine(cells: DataFrame, n: int, keys: list[str], radius: float = 1.0) -> DataFrame:
    """n x n lattice vertices (keys, i, j, x, y, z) of rows with corners c0x..c3z."""
    schema = cells.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    jj, ii = np.divmod(np.arange(n * n), n)
    step = max(1, 200_000 // (n * n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = part.num_rows
                c = np.stack([part.column(s).to_numpy(zero_copy_only=False) for s in SCOPE_NAMES], 1)
                v = refine_block(c.reshape(m, 4, 3), n).reshape(m * n * n, 3) * radius
                rows = pa.array(np.repeat(np.arange(m), n * n))
                cols = [part.column(k).take(rows) for k in keys]
                cols += [pa.array(np.tile(a, m).astype(np.int32)) for a in (ii, jj)]
                cols += [pa.array(np.ascontiguousarray(v[:, a])) for a in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "i", "j", "x", "y", "z"])

    return cells.select(*keys, *SCOPE_NAMES).mapInArrow(
        run, f"{schema}, i int, j int, x double, y double, z double"
    )
