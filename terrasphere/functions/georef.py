"""Pixel <-> geographic transforms over the georeference columns of an image row.

Affine form: columns gt0..gt5, size_x, size_y, point_sampled.
Scale/offset form: explicit sx, sy, ox, oy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS
from terrasphere.functions.sphere import haversine
from terrasphere.functions.vec import num, ratio


class Georef:
    """The affine transform of one image row, optionally under a column prefix."""

    def __init__(self, prefix: str = ""):
        self.g = [F.col(f"{prefix}gt{i}") for i in range(6)]
        self.size_x = F.col(prefix + "size_x")
        self.size_y = F.col(prefix + "size_y")
        self.point_sampled = F.col(prefix + "point_sampled")

    def affine_fwd(self, x, y) -> tuple[Column, Column]:
        g, x, y = self.g, num(x), num(y)
        return g[0] + x * g[1] + y * g[2], g[3] + x * g[4] + y * g[5]

    def affine_inv(self, u, v) -> tuple[Column, Column]:
        g = self.g
        det = g[1] * g[5] - g[2] * g[4]
        du, dv = num(u) - g[0], num(v) - g[3]
        return ratio(du * g[5] - dv * g[2], det), ratio(dv * g[1] - du * g[4], det)

    def _half(self) -> Column:
        return F.when(self.point_sampled, F.lit(0.0)).otherwise(F.lit(0.5))

    def image_to_system(self, x, y) -> tuple[Column, Column]:
        h = self._half()
        return self.affine_fwd(num(x) + h, num(y) + h)

    def system_to_image(self, u, v) -> tuple[Column, Column]:
        """Up to half a pixel outside an area-sampled image snaps to its border pixel."""
        out = []
        for raw, size in zip(self.affine_inv(u, v), (self.size_x, self.size_y)):
            c, last = raw - 0.5, (size - 1).cast("double")
            snapped = (
                F.when((c < 0) & (c >= -0.5), F.lit(0.0))
                .when((c > last) & (c <= last + 0.5), last)
                .otherwise(c)
            )
            out.append(F.when(self.point_sampled, raw).otherwise(snapped))
        return out[0], out[1]

    def image_to_world(self, x, y) -> tuple[Column, Column]:
        u, v = self.image_to_system(x, y)
        return F.radians(u), F.radians(v)

    def world_to_image(self, lon, lat) -> tuple[Column, Column]:
        return self.system_to_image(F.degrees(num(lon)), F.degrees(num(lat)))

    def flip_y(self) -> dict[str, Column]:
        """New gt3, gt5 of the image read bottom-up."""
        return {"gt3": self.g[3] + (self.size_y - 1) * self.g[5], "gt5": -self.g[5]}

    def box_to_system(self, x0, y0, x1, y1) -> tuple[Column, ...]:
        return _corner_box(self.image_to_system(x0, y0), self.image_to_system(x1, y1))

    def box_to_image(self, u0, v0, u1, v1) -> tuple[Column, ...]:
        return _corner_box(self.system_to_image(u0, v0), self.system_to_image(u1, v1))

    def finest_resolution(self, radius=EARTH_RADIUS) -> Column:
        """Shortest one-pixel step at the image centre, in metres."""
        hx, hy = F.floor(self.size_x / 2), F.floor(self.size_y / 2)
        o = self.image_to_world(hx, hy)
        a = self.image_to_world(hx + 1, hy)
        b = self.image_to_world(hx, hy + 1)
        return F.least(haversine(*o, *a, radius), haversine(*o, *b, radius))

    def finest_resolution_geographic(self, radius=EARTH_RADIUS) -> Column:
        """Shortest one-pixel step on the pole-most row (scale/offset reading)."""
        g = self.g
        lon0, lat0 = F.radians(g[0]), F.radians(g[3])
        lon1 = F.radians((self.size_x - 1) * g[1] + g[0])
        lat1 = F.radians((self.size_y - 1) * g[5] + g[3])
        lon = (lon0 + lon1) * 0.5
        lat = F.when(F.abs(lat0) > F.abs(lat1), lat0).otherwise(lat1)
        return F.least(
            haversine(lon, lat, lon + F.radians(g[1]), lat, radius),
            haversine(lon, lat, lon, lat + F.radians(g[5]), radius),
        )


def _corner_box(p, q) -> tuple[Column, ...]:
    return F.least(p[0], q[0]), F.least(p[1], q[1]), F.greatest(p[0], q[0]), F.greatest(p[1], q[1])


def scale_offset_fwd(x, y, sx, sy, ox, oy) -> tuple[Column, Column]:
    return num(x) * num(sx) + num(ox), num(y) * num(sy) + num(oy)


def scale_offset_inv(u, v, sx, sy, ox, oy) -> tuple[Column, Column]:
    return ratio(num(u) - num(ox), sx), ratio(num(v) - num(oy), sy)


def scale_offset_box(x0, y0, x1, y1, sx, sy, ox, oy) -> tuple[Column, ...]:
    """Box image -> system; a negative scale swaps the two ends."""
    return _corner_box(scale_offset_fwd(x0, y0, sx, sy, ox, oy), scale_offset_fwd(x1, y1, sx, sy, ox, oy))


def scale_offset_flip(oy, sy, height) -> tuple[Column, Column]:
    """(offset, scale) of the y axis read bottom-up."""
    return num(oy) + (num(height) - 1) * num(sy), -num(sy)


def flip_coverage_y(y, height) -> Column:
    return num(height) - 1 - num(y)


def grid_phase(offset: Column, scale: Column) -> Column:
    """Offset in thousandths of a pixel modulo one pixel: the equi-join key of compatible grids."""
    p = ratio(offset, scale)
    return (F.floor((p - F.floor(p)) * 1000.0 + 0.5).cast("int") % 1000)


def system_compatible(sx1, sy1, ox1, oy1, sx2, sy2, ox2, oy2) -> Column:
    """Same scale, and an integer pixel offset within 0.001."""
    def whole(o1, o2, s):
        d = ratio(num(o2) - num(o1), s)
        return F.abs(d - F.floor(d + 0.5)) < 0.001

    return (num(sx1) == num(sx2)) & (num(sy1) == num(sy2)) & whole(ox1, ox2, sx1) & whole(oy1, oy2, sy1)
