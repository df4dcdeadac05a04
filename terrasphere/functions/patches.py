"""The 30 base patches of the globe and their neighbourhood."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from terrasphere import EARTH_RADIUS

# The 32 vertices of the base rhombic triacontahedron, numbered from 1.
VERTICES = (
    (0.0, 0.0, -1.61803),
    (0.0, 0.0, 1.61803),
    (0.276393, -0.850651, 1.17082),
    (0.276393, 0.850651, 1.17082),
    (0.894427, 0.0, 1.17082),
    (1.17082, -0.850651, 0.723607),
    (1.17082, -0.850651, -0.276393),
    (1.17082, 0.850651, 0.723607),
    (1.17082, 0.850651, -0.276393),
    (-0.894427, 0.0, -1.17082),
    (-0.447214, -1.37638, 0.723607),
    (-0.447214, -1.37638, -0.276393),
    (-0.447214, 1.37638, 0.723607),
    (-0.447214, 1.37638, -0.276393),
    (0.447214, -1.37638, 0.276393),
    (0.447214, -1.37638, -0.723607),
    (0.447214, 1.37638, 0.276393),
    (0.447214, 1.37638, -0.723607),
    (-1.44721, 0.0, 0.723607),
    (-1.44721, 0.0, -0.276393),
    (-0.723607, -0.525731, 1.17082),
    (-0.723607, 0.525731, 1.17082),
    (0.723607, -0.525731, -1.17082),
    (0.723607, 0.525731, -1.17082),
    (1.44721, 0.0, 0.276393),
    (1.44721, 0.0, -0.723607),
    (-1.17082, -0.850651, 0.276393),
    (-1.17082, -0.850651, -0.723607),
    (-1.17082, 0.850651, 0.276393),
    (-1.17082, 0.850651, -0.723607),
    (-0.276393, -0.850651, -1.17082),
    (-0.276393, 0.850651, -1.17082),
)

# Corner vertices of each patch, in the order lower left, lower right,
# upper left, upper right.
PATCHES = (
    (10, 1, 28, 31), (31, 1, 16, 23), (23, 1, 26, 24), (24, 1, 18, 32), (32, 1, 30, 10),
    (31, 16, 28, 12), (23, 26, 16, 7), (24, 18, 26, 9), (32, 30, 18, 14), (10, 28, 30, 20),
    (20, 28, 19, 27), (12, 11, 28, 27), (12, 16, 11, 15), (7, 6, 16, 15), (7, 26, 6, 25),
    (9, 8, 26, 25), (9, 18, 8, 17), (14, 13, 18, 17), (14, 30, 13, 29), (20, 19, 30, 29),
    (27, 11, 19, 21), (15, 6, 11, 3), (25, 8, 6, 5), (17, 13, 8, 4), (29, 19, 13, 22),
    (21, 11, 2, 3), (3, 6, 2, 5), (5, 8, 2, 4), (4, 13, 2, 22), (22, 19, 2, 21),
)

# Corner pairs of the sides top, left, bottom, right, counter-clockwise.
SIDES = ((3, 2), (2, 0), (0, 1), (1, 3))


def _unit(v):
    v = np.asarray(v, dtype=np.float64)
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


ROOT_CORNERS = _unit(np.array([[VERTICES[i - 1] for i in quad] for quad in PATCHES]))


def base_patches(spark: SparkSession, radius: float = EARTH_RADIUS) -> DataFrame:
    rows = [
        (p, c, *(float(v) * radius for v in ROOT_CORNERS[p, c])) for p in range(30) for c in range(4)
    ]
    return spark.createDataFrame(rows, "patch int, corner int, x double, y double, z double")


def base_scopes(spark: SparkSession, radius: float = 1.0) -> DataFrame:
    """One row per patch with the corners as columns c0x..c3z."""
    names = ", ".join(f"c{c}{a} double" for c in range(4) for a in "xyz")
    rows = [(p, *(float(v) * radius for v in ROOT_CORNERS[p].reshape(-1))) for p in range(30)]
    return spark.createDataFrame(rows, f"patch int, {names}")


def neighbor_table() -> list[tuple[int, int, int, int, int]]:
    """(patch, side, neighbour, orientation, side of the neighbour), from shared edges.

    Orientation counts the quarter turns between the two frames: 0 when a side meets
    the opposite side of its neighbour.
    """
    owner = {}
    for p, quad in enumerate(PATCHES):
        for s, (a, b) in enumerate(SIDES):
            owner[(quad[a], quad[b])] = (p, s)
    out = []
    for p, quad in enumerate(PATCHES):
        for s, (a, b) in enumerate(SIDES):
            q, t = owner[(quad[b], quad[a])]
            out.append((p, s, q, (s + 2 - t) % 4, t))
    return out


def base_neighbors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        neighbor_table(), "patch int, side int, neighbor int, orientation int, neighbor_side int"
    )


def _side_normals() -> np.ndarray:
    """(30, 4, 3) inward normals of the planes through the centre and each side."""
    a = ROOT_CORNERS[:, [s[0] for s in SIDES]]
    b = ROOT_CORNERS[:, [s[1] for s in SIDES]]
    return _unit(np.cross(a, _unit(b - a)))


SIDE_NORMALS = _side_normals()


def edge_angle(patch: int = 0) -> float:
    a, b = ROOT_CORNERS[patch, 0], ROOT_CORNERS[patch, 1]
    return math.acos(float(a @ b))


def resolution_at(level: int, n: int = 65, radius: float = EARTH_RADIUS) -> float:
    """Sample spacing along the lower side of patch 0, in metres; halves per level."""
    return radius * edge_angle() / ((n - 1) * 2.0**level)
