"""Column expressions for geometry, colour and scores; nothing here leaves code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the constant of the zeroth spherical harmonic.
SH_C0 = 0.28209479177387814


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def voxel_key(x: Column, size: float, centred: bool = False) -> Column:
    """floor(x / size), or floor(x / size + 0.5) for welding."""
    return F.floor(x / F.lit(size) + F.lit(0.5 if centred else 0.0)).cast("long")


def norm(*xs: Column) -> Column:
    total = xs[0] * xs[0]
    for x in xs[1:]:
        total = total + x * x
    return F.sqrt(total)


def rotation_angle(trace: Column) -> Column:
    """Degrees of the rotation whose matrix has this trace."""
    return F.degrees(F.acos(clip((trace - 1) / 2, -1.0, 1.0)))


def axis_rotation(axis: tuple[Column, Column, Column], angle: Column) -> list[Column]:
    """Nine entries, by rows, of the rotation about a unit axis."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, t * x * y + s * z, t * y * y + c, t * y * z - s * x, t * x * z - s * y, t * y * z + s * x, t * z * z + c]


def apply_rigid(matrix: list[Column], shift: list[Column], point: list[Column]) -> list[Column]:
    return [matrix[3 * i] * point[0] + matrix[3 * i + 1] * point[1] + matrix[3 * i + 2] * point[2] + shift[i] for i in range(3)]


def quaternion_product(p: list[Column], q: list[Column]) -> list[Column]:
    """Hamilton product of w, x, y, z quaternions."""
    a, b = p, q
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    v = clip(v, 0.0, 1.0)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def to_byte(x: Column) -> Column:
    """Half-even rounding of a clipped unit value to 0..255."""
    return F.rint(clip(x, 0.0, 1.0) * 255).cast("int")


def brown_lens(x: Column, y: Column, k: tuple[float, float, float], p: tuple[float, float]) -> tuple[Column, Column]:
    """Normalised coordinates through radial and tangential distortion."""
    r2 = x * x + y * y
    radial = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
    return x * radial + 2 * p[0] * x * y + p[1] * (r2 + 2 * x * x), y * radial + p[0] * (r2 + 2 * y * y) + 2 * p[1] * x * y


def rational_lens(x: Column, y: Column, k: list[float]) -> tuple[Column, Column]:
    """Normalised coordinates through a lens of eight coefficients k1 k2 p1 p2 k3 k4 k5 k6 (P4); null where the denominator vanishes."""
    r2 = x * x + y * y
    below = 1 + r2 * (k[5] + r2 * (k[6] + r2 * k[7]))
    radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[4]))) / F.when(F.abs(below) > 1e-12, below)
    return x * radial + 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x), y * radial + k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y


def saturating(x: Column, target: float) -> Column:
    return clip(x / target, 0.0, 1.0)


def halton(index: Column, base: int, digits: int) -> Column:
    """Radical inverse of an index in a base, of at most `digits` digits."""
    total, rest = F.lit(0.0), index
    for d in range(digits):
        total = total + F.pmod(rest, F.lit(base)) / F.lit(float(base ** (d + 1)))
        rest = F.floor(rest / base)
    return total
