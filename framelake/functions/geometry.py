"""Rigid and affine transforms as columns.

A transform is an ``array<double>`` of twelve numbers, the upper three rows of
a 4x4 matrix in row order; the last row is always (0, 0, 0, 1).  Everything is
unrolled arithmetic, so whole-stage code generation covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ratios import col

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def cells(t: Column | str) -> list[Column]:
    return [col(t).getItem(i) for i in range(12)]


def literal(values: list[float]) -> Column:
    """Twelve or sixteen plain numbers as a transform column."""
    return F.array(*[F.lit(float(v)) for v in values[:12]])


def product(a: Column | str, b: Column | str) -> Column:
    """Matrix product ``a @ b``."""
    x, y = cells(a), cells(b)
    out = []
    for r in range(3):
        row = x[4 * r: 4 * r + 4]
        for c in range(4):
            s = row[0] * y[c] + row[1] * y[4 + c] + row[2] * y[8 + c]
            out.append(s + row[3] if c == 3 else s)
    return F.array(*out)


def inverse(t: Column | str) -> Column:
    """Inverse of a rigid transform: transposed rotation, rotated translation."""
    m = cells(t)
    out = []
    for c in range(3):
        column = [m[c], m[4 + c], m[8 + c]]
        out += column
        out.append(-(column[0] * m[3] + column[1] * m[7] + column[2] * m[11]))
    return F.array(*out)


def relative(a: Column | str, b: Column | str) -> Column:
    """Pose ``b`` seen from pose ``a``."""
    return product(inverse(a), b)


def move(t: Column | str, x: Column, y: Column, z: Column | None = None) -> list[Column]:
    """Transform applied to a point; ``z`` defaults to the image plane."""
    m = cells(t)
    out = []
    for r in range(3):
        s = m[4 * r] * x + m[4 * r + 1] * y
        if z is not None:
            s = s + m[4 * r + 2] * z
        out.append(s + m[4 * r + 3])
    return out


def translation(t: Column | str) -> list[Column]:
    return [col(t).getItem(i) for i in (3, 7, 11)]


def from_euler(x, y, z, ex, ey, ez) -> Column:
    """Transform from a translation and extrinsic x-y-z angles in degrees."""
    a, b, c = (F.radians(col(v)) for v in (ex, ey, ez))
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    return F.array(
        cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, col(x),
        sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, col(y),
        -sb, cb * sa, cb * ca, col(z),
    )


def to_euler(t: Column | str) -> list[Column]:
    """(x, y, z, ex, ey, ez) of a rigid transform, angles in degrees.

    Where the middle angle is a right angle the last one is set to zero.
    """
    m = cells(t)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[8]))
    locked = F.abs(m[8]) >= 1.0 - 1e-12
    ey = F.degrees(F.asin(s))
    ex = F.when(locked, F.degrees(F.atan2(-m[6], m[5]))).otherwise(F.degrees(F.atan2(m[9], m[10])))
    ez = F.when(locked, F.lit(0.0)).otherwise(F.degrees(F.atan2(m[4], m[0])))
    return [m[3], m[7], m[11], ex, ey, ez]


def to_quaternion(t: Column | str) -> list[Column]:
    """(qx, qy, qz, qw) of the rotation, by the largest of four denominators."""
    m = cells(t)
    r00, r11, r22 = m[0], m[5], m[10]
    trace = r00 + r11 + r22
    s_w = F.sqrt(F.greatest(trace + 1.0, F.lit(1e-300))) * 2
    s_x = F.sqrt(F.greatest(1.0 + r00 - r11 - r22, F.lit(1e-300))) * 2
    s_y = F.sqrt(F.greatest(1.0 + r11 - r00 - r22, F.lit(1e-300))) * 2
    s_z = F.sqrt(F.greatest(1.0 + r22 - r00 - r11, F.lit(1e-300))) * 2
    by_w = ((m[9] - m[6]) / s_w, (m[2] - m[8]) / s_w, (m[4] - m[1]) / s_w, s_w / 4)
    by_x = (s_x / 4, (m[1] + m[4]) / s_x, (m[2] + m[8]) / s_x, (m[9] - m[6]) / s_x)
    by_y = ((m[1] + m[4]) / s_y, s_y / 4, (m[6] + m[9]) / s_y, (m[2] - m[8]) / s_y)
    by_z = ((m[2] + m[8]) / s_z, (m[6] + m[9]) / s_z, s_z / 4, (m[4] - m[1]) / s_z)
    return [
        F.when(trace > 0, w).when((r00 > r11) & (r00 > r22), x).when(r11 > r22, y).otherwise(z)
        for w, x, y, z in zip(by_w, by_x, by_y, by_z)
    ]


def norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def corners(width: Column, height: Column) -> Column:
    """The four image corners as (corner, x, y) structs, clockwise from the origin."""
    w, h, o = width - 1, height - 1, F.lit(0.0)
    pts = [(o, o), (w, o), (w, h), (o, h)]
    return F.array(*[
        F.struct(F.lit(i).alias("corner"), x.cast("double").alias("x"), y.cast("double").alias("y"))
        for i, (x, y) in enumerate(pts)
    ])
