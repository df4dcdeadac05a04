"""Ray, plane and triangle tests. Each returns the ray parameter, NULL for no hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasphere.functions.vec import V3, num, ratio

PLANE_EPS = 1e-12
TRIANGLE_EPS = 1e-6


def ray_sphere_both(o: V3, d: V3, c: V3, r) -> tuple[Column, Column]:
    r = num(r)
    oc = o - c
    d2, ph = d.dot(d), oc.dot(d)
    det = ph * ph - (oc.dot(oc) - r * r) * d2
    root = F.when(det >= 0, F.sqrt(F.greatest(det, F.lit(0.0))))
    return ratio(-ph - root, d2), ratio(-ph + root, d2)


def ray_sphere(o: V3, d: V3, c: V3, r) -> Column:
    t0, t1 = ray_sphere_both(o, d, c, r)
    return F.when(t0 >= 0, t0).when(t1 >= 0, t1)


def section_normal(start: V3, end: V3) -> V3:
    return start.cross(end).unit()


class Section:
    """Great-circle section start..end: its normal and the tangents at both ends.

    The plane holds the sphere centre and each tangent is orthogonal to its end, so hit
    tests need no square roots. Put the three vectors into columns once per section.
    """

    def __init__(self, n: V3, ta: V3, tb: V3):
        self.n, self.ta, self.tb = n, ta, tb

    @staticmethod
    def between(start: V3, end: V3) -> "Section":
        along = end - start
        return Section(
            section_normal(start, end),
            along - start * ratio(along.dot(start), start.dot(start)),
            -along + end * ratio(along.dot(end), end.dot(end)),
        )

    @staticmethod
    def of(prefix: str) -> "Section":
        return Section(V3.of(prefix + "n"), V3.of(prefix + "a"), V3.of(prefix + "b"))

    def vectors(self, prefix: str) -> dict[str, V3]:
        return {prefix + "n": self.n, prefix + "a": self.ta, prefix + "b": self.tb}


def ray_plane(o: V3, d: V3, s: Section, cull_back: bool = False) -> Column:
    nd, no = s.n.dot(d), s.n.dot(o)
    hit = F.when(F.abs(nd) >= PLANE_EPS, ratio(-no, nd)).when(F.abs(no) < PLANE_EPS, F.lit(0.0))
    return F.when(nd <= 0, hit) if cull_back else hit


def within_section(o: V3, d: V3, s: Section, t: Column) -> Column:
    """t where the hit lies between the tangent planes at both ends."""
    return F.when((s.ta.dot(o) + t * s.ta.dot(d) >= 0) & (s.tb.dot(o) + t * s.tb.dot(d) >= 0), t)


def ray_section(o: V3, d: V3, s: Section, cull_back: bool = False) -> Column:
    return within_section(o, d, s, ray_plane(o, d, s, cull_back))


def ray_triangle(o: V3, d: V3, a: V3, b: V3, c: V3) -> Column:
    """Front faces only."""
    e1, e2, tv = b - a, c - a, o - a
    pv, qv = d.cross(e2), tv.cross(e1)
    det = e1.dot(pv)
    u, v = tv.dot(pv), d.dot(qv)
    return F.when(
        (det >= TRIANGLE_EPS) & (u >= 0) & (u <= det) & (v >= 0) & (u + v <= det),
        ratio(e2.dot(qv), det),
    )


def ray_wedge(o: V3, d: V3, start: V3, end: V3) -> Column:
    """Infinite wedge spanned by the sphere centre, start and end."""
    pv, qv = d.cross(end), o.cross(start)
    det = start.dot(pv)
    u, v = ratio(o.dot(pv), det), ratio(d.dot(qv), det)
    return F.when((F.abs(det) >= PLANE_EPS) & (u >= 0) & (v >= 0), ratio(end.dot(qv), det))


def project_to_section(p: V3, start: V3, end: V3) -> V3:
    m = start.cross(end)
    return p - m * ratio(p.dot(m), m.dot(m))


def section_side(p: V3, start: V3, normal: V3) -> Column:
    return (p - start).dot(normal) >= 0


def closest_on_segment(p: V3, start: V3, end: V3) -> Column:
    """Parameter on start..end nearest to the line from the centre through p."""
    u = end - start
    a, b, c, d, e = u.dot(u), u.dot(p), p.dot(p), u.dot(start), p.dot(start)
    den = a * c - b * b
    return F.when(F.abs(den) >= PLANE_EPS, ratio(b * e - c * d, den))
