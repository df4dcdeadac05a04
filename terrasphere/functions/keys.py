"""Cell keys: (patch, level, path) and the packed 64-bit form.

path holds two bits per level, the first step in the lowest bits; bit 0 of a step
is x, bit 1 is y. Layout of the packed key, lowest bits first: 5 reserved (all
ones), 5 patch, 2 child, 6 level, 46 path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasphere import MAX_LEVEL

RESERVED_BITS, PATCH_BITS, CHILD_BITS, LEVEL_BITS, PATH_BITS = 5, 5, 2, 6, 46
PATCH_AT = RESERVED_BITS
CHILD_AT = PATCH_AT + PATCH_BITS
LEVEL_AT = CHILD_AT + CHILD_BITS
PATH_AT = LEVEL_AT + LEVEL_BITS


def shl(c: Column, n) -> Column:
    return F.call_function("shiftleft", c.cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def shr(c: Column, n) -> Column:
    return F.call_function("shiftrightunsigned", c.cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def low_mask(levels: Column) -> Column:
    """4^levels - 1."""
    return shl(F.lit(1), (levels * 2).cast("int")) - 1


def step(path: Column, k: Column) -> Column:
    return shr(path, (k * 2).cast("int")).bitwiseAND(F.lit(3).cast("bigint"))


def last_child(level: Column, path: Column) -> Column:
    return F.when(level > 0, step(path, level - 1)).otherwise(F.lit(0).cast("bigint"))


def pack(patch: Column, level: Column, path: Column) -> Column:
    return (
        F.lit((1 << RESERVED_BITS) - 1).cast("bigint")
        .bitwiseOR(shl(patch, PATCH_AT))
        .bitwiseOR(shl(last_child(level, path), CHILD_AT))
        .bitwiseOR(shl(level, LEVEL_AT))
        .bitwiseOR(shl(path, PATH_AT))
    )


def _bits(key: Column, at: int, n: int) -> Column:
    return shr(key, at).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def unpack(key: Column) -> dict[str, Column]:
    return {
        "reserved": _bits(key, 0, RESERVED_BITS).cast("int"),
        "patch": _bits(key, PATCH_AT, PATCH_BITS).cast("int"),
        "child": _bits(key, CHILD_AT, CHILD_BITS).cast("int"),
        "level": _bits(key, LEVEL_AT, LEVEL_BITS).cast("int"),
        "path": _bits(key, PATH_AT, PATH_BITS),
    }


def ancestor_path(path: Column, level: Column) -> Column:
    return path.bitwiseAND(low_mask(level))


def parent(level: Column, path: Column) -> tuple[Column, Column]:
    up = F.greatest(level - 1, F.lit(0))
    return up, ancestor_path(path, up)


def child(level: Column, path: Column, which: Column) -> tuple[Column, Column]:
    return level + 1, path.bitwiseOR(shl(which, (level * 2).cast("int")))


def path_steps(level: Column, path: Column) -> Column:
    """array of steps, root first."""
    return F.when(level > 0, F.transform(F.sequence(F.lit(0), level - 1), lambda k: step(path, k))).otherwise(
        F.array().cast("array<bigint>")
    )


def path_string(level: Column, path: Column) -> Column:
    digits = F.concat_ws("", F.transform(path_steps(level, path), lambda s: s.cast("string")))
    return F.when(level == (1 << LEVEL_BITS) - 1, "i").when(level == 0, "r").otherwise(digits)


def med_string(reserved: Column, patch: Column, level: Column, path: Column) -> Column:
    res = F.when(reserved == (1 << RESERVED_BITS) - 1, "i").otherwise(reserved.cast("string"))
    pat = F.when(patch == (1 << PATCH_BITS) - 1, "i").otherwise(patch.cast("string"))
    return F.concat(res, F.lit("|"), pat, F.lit("."), path_string(level, path))


def tile_xy(level: Column, path: Column) -> tuple[Column, Column]:
    """Lattice tile coordinates of a cell, unrolled over the 23 possible levels.

    No lambda on purpose: inside one, a column would resolve to an alias of the same
    name in the same select.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    tx, ty = zero, zero
    for k in range(MAX_LEVEL):
        up = (level - 1 - k).cast("int")
        live = level > k
        tx = tx + F.when(live, shl(shr(path, 2 * k).bitwiseAND(one), up)).otherwise(zero)
        ty = ty + F.when(live, shl(shr(path, 2 * k + 1).bitwiseAND(one), up)).otherwise(zero)
    return tx, ty


def path_of_tile(level: Column, tx: Column, ty: Column) -> Column:
    """Inverse of tile_xy, unrolled over the 23 possible levels (stays in generated code)."""
    out = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    for k in range(MAX_LEVEL):
        bit = (level - 1 - k).cast("int")
        s = shr(tx, bit).bitwiseAND(one) + shr(ty, bit).bitwiseAND(one) * 2
        out = out + F.when(level > k, shl(s, 2 * k)).otherwise(F.lit(0).cast("bigint"))
    return out
