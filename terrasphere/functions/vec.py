"""3-vectors of Columns. Everything here is a plain Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero (also in ANSI mode)."""
    return F.try_divide(num(a), num(b))


class V3:
    __slots__ = ("x", "y", "z")

    def __init__(self, x, y, z):
        self.x, self.y, self.z = num(x), num(y), num(z)

    @staticmethod
    def of(prefix: str) -> "V3":
        return Named(prefix)

    @staticmethod
    def field(struct: Column) -> "V3":
        return V3(struct.getField("x"), struct.getField("y"), struct.getField("z"))

    def __add__(self, o):
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o):
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def __neg__(self):
        return V3(-self.x, -self.y, -self.z)

    def __mul__(self, s):
        return V3(self.x * s, self.y * s, self.z * s)

    def over(self, s):
        return V3(ratio(self.x, s), ratio(self.y, s), ratio(self.z, s))

    def dot(self, o) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o) -> "V3":
        return V3(
            self.y * o.z - self.z * o.y,
            self.z * o.x - self.x * o.z,
            self.x * o.y - self.y * o.x,
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> "V3":
        return self.over(self.norm())

    def dist(self, o) -> Column:
        return (self - o).norm()

    def cols(self, prefix: str) -> list[Column]:
        return [self.x.alias(prefix + "x"), self.y.alias(prefix + "y"), self.z.alias(prefix + "z")]

    def struct(self) -> Column:
        return F.struct(*self.cols(""))


class Named(V3):
    """Vector of the columns <prefix>x, <prefix>y, <prefix>z, resolved when used."""

    __slots__ = ("prefix",)

    def __init__(self, prefix: str):
        self.prefix = prefix

    x = property(lambda self: F.col(self.prefix + "x"))
    y = property(lambda self: F.col(self.prefix + "y"))
    z = property(lambda self: F.col(self.prefix + "z"))


def put(df: DataFrame, **vectors: V3) -> DataFrame:
    """Materialise vectors as columns, so later expressions refer to them by name."""
    out = {}
    for prefix, v in vectors.items():
        out.update({prefix + "x": v.x, prefix + "y": v.y, prefix + "z": v.z})
    return df.withColumns(out)


def names(*prefixes: str) -> list[str]:
    return [p + a for p in prefixes for a in "xyz"]


def quantize(c: Column, scale: float = 1e6) -> Column:
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")
