"""Fragments of DuckDB SQL for the oracle twins; vectors are columns <name>x, <name>y, <name>z."""

from __future__ import annotations

from terrasphere.functions.patches import PATCHES, SIDES, VERTICES

R = "CAST(6371000 AS DOUBLE)"


def q(expr: str, scale: float = 1e6) -> str:
    return f"CAST(floor(({expr})*{scale:.1f}+0.5) AS BIGINT)"


def dot(a: str, b: str) -> str:
    return f"({a}x*{b}x+{a}y*{b}y+{a}z*{b}z)"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def cross(a: str, b: str, out: str) -> str:
    return (
        f"{a}y*{b}z-{a}z*{b}y AS {out}x, {a}z*{b}x-{a}x*{b}z AS {out}y, {a}x*{b}y-{a}y*{b}x AS {out}z"
    )


def unit(a: str, out: str) -> str:
    return ", ".join(f"{a}{c}/{norm(a)} AS {out}{c}" for c in "xyz")


def lin(out: str, *terms: tuple[str, str]) -> str:
    """out = sum of factor * vector."""
    return ", ".join("+".join(f"({f})*{v}{c}" for f, v in terms) + f" AS {out}{c}" for c in "xyz")


def cols(*names: str) -> str:
    return ", ".join(f"{n}{c}" for n in names for c in "xyz")


def sph(lon: str, lat: str, out: str, r: str = "1.0") -> str:
    """Vector of degrees lon, lat."""
    return (
        f"({r})*cos(radians({lon}))*cos(radians({lat})) AS {out}x, "
        f"({r})*sin(radians({lon}))*cos(radians({lat})) AS {out}y, ({r})*sin(radians({lat})) AS {out}z"
    )


def hav(lon1: str, lat1: str, lon2: str, lat2: str, r: str = R) -> str:
    a = (
        f"(pow(sin((({lat2})-({lat1}))/2),2)+cos({lat1})*cos({lat2})*pow(sin((({lon2})-({lon1}))/2),2))"
    )
    return f"(({r})*2*atan2(sqrt({a}),sqrt(greatest(1-{a},0))))"


def _base_values() -> str:
    out = []
    for p, quad in enumerate(PATCHES):
        out.append(f"({p}," + ",".join(f"CAST({v} AS DOUBLE)" for i in quad for v in VERTICES[i - 1]) + ")")
    return ",".join(out)


BASE = (
    "base_raw(patch," + ",".join(f"{n}{c}" for n in ("ra", "rf", "rc", "rd") for c in "xyz") + f") AS (VALUES {_base_values()}),\n"
    "base AS (SELECT patch, " + ", ".join(unit("r" + n, n) for n in "afcd") + " FROM base_raw)"
)
CORNERS = "afcd"

def split_from(source: str) -> str:
    """Relation with the five points of a split (t, l, m, r, o) beside corners a f c d.

    Nested selects instead of lateral aliases: DuckDB would expand those repeatedly.
    """
    mids = ", ".join(lin(n + "0", ("1", u), ("1", v)) for n, u, v in (("t", "d", "c"), ("l", "c", "a"), ("m", "a", "f"), ("r", "f", "d")))
    units = ", ".join(unit(n + "0", n) for n in "tlmr")
    return (
        f"(SELECT *, {unit('o0', 'o')} FROM (SELECT *, {lin('o0', ('1', 't'), ('1', 'm'))} FROM (SELECT *, {units} FROM (SELECT *, {mids} FROM {source}))))"
    )


_KIDS = {0: "amlo", 1: "mfor", 2: "loct", 3: "ortd"}


def pick(child: str) -> str:
    """Corners a f c d of the given child."""
    out = []
    for i, corner in enumerate(CORNERS):
        for c in "xyz":
            out.append(
                f"CASE {child} " + " ".join(f"WHEN {k} THEN {v[i]}{c}" for k, v in _KIDS.items()) + f" END AS {corner}{c}"
            )
    return ", ".join(out)


def sides_inside(p: str) -> str:
    """Half-space tests of corners a f c d against p."""
    tests = []
    for i, j in SIDES:
        u, v = CORNERS[i], CORNERS[j]
        tests.append(
            f"(({u}y*{v}z-{u}z*{v}y)*{p}x+({u}z*{v}x-{u}x*{v}z)*{p}y+({u}x*{v}y-{u}y*{v}x)*{p}z)>=0"
        )
    return " AND ".join(tests)


def patch_cte(source: str, key: str, p: str, name: str = "patched") -> str:
    """name(key, px.., patch, corners) from a relation that holds key and vector p."""
    return (
        f"{name}_hits AS (SELECT s.{key}, s.{p}x, s.{p}y, s.{p}z, base.* FROM {source} s JOIN base ON {sides_inside('s.' + p)}),\n"
        f"{name} AS (SELECT * FROM {name}_hits QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY patch)=1)"
    )


def descent_cte(source: str, key: str, p: str, levels: int, name: str = "walk") -> str:
    """Recursive descent of points to the given level; needs a, f, c, d corners and patch in source."""
    return (
        f"{name} AS (SELECT {key}, {cols(p)}, patch, 0 AS level, CAST(0 AS BIGINT) AS path, {cols(*CORNERS)} FROM {source}\n"
        f" UNION ALL SELECT {key}, {cols(p)}, patch, level+1, path + child*CAST(pow(4,level) AS BIGINT), {pick('child')} FROM (\n"
        f"  SELECT *, (CASE WHEN {dot(p, 'vn')}<0 THEN 1 ELSE 0 END)+(CASE WHEN {dot(p, 'hn')}<0 THEN 2 ELSE 0 END) AS child FROM (SELECT *, {cross('v1', 'v2', 'vn')}, {cross('h1', 'h2', 'hn')} FROM (\n"
        f"  SELECT *, {lin('v1', ('1', 'a'), ('1', 'f'))}, {lin('v2', ('1', 'c'), ('1', 'd'))}, {lin('h1', ('1', 'f'), ('1', 'd'))}, {lin('h2', ('1', 'a'), ('1', 'c'))}\n"
        f"  FROM {split_from(f'(SELECT * FROM {name} WHERE level<{levels})')}))))"
    )


def cells_cte(levels: int, name: str = "cells") -> str:
    """All cells of levels 0..levels with corners."""
    return (
        f"{name} AS (SELECT patch, 0 AS level, CAST(0 AS BIGINT) AS path, {cols(*CORNERS)} FROM base\n"
        f" UNION ALL SELECT patch, level+1, path + child*CAST(pow(4,level) AS BIGINT), {pick('child')} FROM (\n"
        f"  SELECT * FROM {split_from(f'(SELECT * FROM {name} WHERE level<{levels})')}) JOIN (VALUES (0),(1),(2),(3)) AS k(child) ON true)"
    )


def section_normal(s: str, e: str, out: str) -> str:
    return f"{cross(s, e, out + '0')}, {unit(out + '0', out)}"


def plane_hit(o: str, d: str, s: str, n: str) -> str:
    nd = dot(n, d)
    to = f"(({n}x*({o}x-{s}x))+({n}y*({o}y-{s}y))+({n}z*({o}z-{s}z)))"
    return f"(CASE WHEN abs({nd})<1e-12 THEN CASE WHEN abs({to})<1e-12 THEN 0.0 END ELSE -{to}/{nd} END)"
