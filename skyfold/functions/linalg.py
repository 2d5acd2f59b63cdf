"""Small vector and matrix algebra as Column expressions.

A vector is a tuple of three columns; a 3x3 matrix is nine columns in row-major
order. Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def arr3(col: str | Column) -> Vec:
    c = F.col(col) if isinstance(col, str) else col
    return tuple(c[i] for i in range(3))


def arr9(col: str | Column) -> list[Column]:
    c = F.col(col) if isinstance(col, str) else col
    return [c[i] for i in range(9)]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(s, a: Vec) -> Vec:
    return tuple(s * p for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def mat_vec(m: list[Column], v: Vec) -> Vec:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def transpose(m: list[Column]) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def mat_mul(a: list[Column], b: list[Column]) -> list[Column]:
    return [
        a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
        for i in range(3)
        for j in range(3)
    ]


def skew(t: Vec) -> list[Column]:
    zero = F.lit(0.0)
    return [zero, -t[2], t[1], t[2], zero, -t[0], -t[1], t[0], zero]


def clip(c: Column, low: float, high: float) -> Column:
    """Bounds a value; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-up rounding without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def camera_centre(r: list[Column], t: Vec) -> Vec:
    """C = -R't."""
    return tuple(-p for p in mat_vec(transpose(r), t))


def quaternion_wxyz(m: list[Column]) -> list[Column]:
    """Rotation matrix to unit quaternion (w, x, y, z) with w or the largest term positive.

    The largest of the four squared components picks the stable branch.
    """
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    tr = m00 + m11 + m22
    sw = F.sqrt(F.greatest(F.lit(0.0), 1.0 + tr)) * 2.0
    sx = F.sqrt(F.greatest(F.lit(0.0), 1.0 + m00 - m11 - m22)) * 2.0
    sy = F.sqrt(F.greatest(F.lit(0.0), 1.0 - m00 + m11 - m22)) * 2.0
    sz = F.sqrt(F.greatest(F.lit(0.0), 1.0 - m00 - m11 + m22)) * 2.0

    def quot(a: Column, b: Column) -> Column:
        return F.try_divide(a, b)

    branches = [
        (tr >= F.greatest(m00, m11, m22),
         [sw / 4.0, quot(m21 - m12, sw), quot(m02 - m20, sw), quot(m10 - m01, sw)]),
        ((m00 >= m11) & (m00 >= m22),
         [quot(m21 - m12, sx), sx / 4.0, quot(m01 + m10, sx), quot(m02 + m20, sx)]),
        (m11 >= m22,
         [quot(m02 - m20, sy), quot(m01 + m10, sy), sy / 4.0, quot(m12 + m21, sy)]),
        (F.lit(True),
         [quot(m10 - m01, sz), quot(m02 + m20, sz), quot(m12 + m21, sz), sz / 4.0]),
    ]
    out = []
    for i in range(4):
        expr = F
        for cond, values in branches[:-1]:
            expr = expr.when(cond, values[i])
        out.append(expr.otherwise(branches[-1][1][i]))
    return out


def euler_deg(m: list[Column]) -> dict[str, Column]:
    """Yaw, pitch, roll in degrees of Rz(yaw) Ry(pitch) Rx(roll), with the gimbal case."""
    pitch = F.asin(clip(-m[6], -1.0, 1.0))
    regular = F.abs(F.cos(pitch)) > 1e-4
    roll = F.when(regular, F.atan2(m[7], m[8])).otherwise(F.lit(0.0))
    yaw = F.when(regular, F.atan2(m[3], m[0])).otherwise(F.atan2(-m[1], m[4]))
    return {"yaw_deg": F.degrees(yaw), "pitch_deg": F.degrees(pitch), "roll_deg": F.degrees(roll)}
