"""Column expressions for matrices, quaternions and planes. Matrices are lists of columns, by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.geom import clip, norm


def product(a: list[Column], b: list[Column], n: int) -> list[Column]:
    """The product of two n x n matrices (M6, M7)."""
    return [sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j]) for i in range(n) for j in range(n)]


def determinant(m: list[Column]) -> Column:
    """Of a 3 x 3 matrix (M7)."""
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def rigid_inverse(m: list[Column]) -> list[Column]:
    """Of a 4 x 4 rigid motion (M6): the transposed rotation, and the shift turned back."""
    r = [[m[4 * j + i] for j in range(3)] for i in range(3)]
    back = [-(row[0] * m[3] + row[1] * m[7] + row[2] * m[11]) for row in r]
    return [*r[0], back[0], *r[1], back[1], *r[2], back[2], *map(F.lit, (0.0, 0.0, 0.0, 1.0))]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: list[Column], least: float = 1e-12) -> list[Column]:
    length = F.greatest(norm(*a), F.lit(least))
    return [x / length for x in a]


def rotation_of(q: list[Column]) -> list[Column]:
    """The rotation of a unit quaternion w, x, y, z (M4)."""
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def quaternion_of(m: list[Column]) -> Column:
    """The unit quaternion [w, x, y, z] of a rotation (M3): from the trace if it is positive, else from the largest diagonal entry, the first of equals."""
    trace = m[0] + m[4] + m[8]

    def s(inner: Column) -> Column:
        return 2 * F.sqrt(F.greatest(inner, F.lit(0.0)))

    a, b, c, d = s(trace + 1), s(1 + m[0] - m[4] - m[8]), s(1 + m[4] - m[0] - m[8]), s(1 + m[8] - m[0] - m[4])
    return (
        F.when(trace > 0, F.array(a / 4, (m[7] - m[5]) / a, (m[2] - m[6]) / a, (m[3] - m[1]) / a))
        .when((m[0] >= m[4]) & (m[0] >= m[8]), F.array((m[7] - m[5]) / b, b / 4, (m[1] + m[3]) / b, (m[2] + m[6]) / b))
        .when(m[4] >= m[8], F.array((m[2] - m[6]) / c, (m[1] + m[3]) / c, c / 4, (m[5] + m[7]) / c))
        .otherwise(F.array((m[3] - m[1]) / d, (m[2] + m[6]) / d, (m[5] + m[7]) / d, d / 4))
    )


def six_numbers_rotation(first: list[Column], second: list[Column]) -> list[Column]:
    """Rows of the rotation that two vectors span (M5): the first made unit, the second made square to it, and their cross product."""
    x = unit(first, 1e-8)
    along = dot(x, second)
    y = unit([s - along * e for s, e in zip(second, x)], 1e-8)
    return [*x, *y, *cross(x, y)]


def plane_axes(normal: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit axes of the plane with this normal (M17), from the coordinate axis least along it, the first of equals; no normal counts as z."""
    length = norm(*normal)
    n = [F.when(length <= 1e-12, F.lit(float(i == 2))).otherwise(c / length) for i, c in enumerate(normal)]
    size = [F.abs(c) for c in n]
    which = F.when((size[0] <= size[1]) & (size[0] <= size[2]), 0).when(size[1] <= size[2], 1).otherwise(2)
    u = unit(cross(n, [F.when(which == i, 1.0).otherwise(0.0) for i in range(3)]))
    return u, cross(n, u)


def symmetric_eigenvalues(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """Eigenvalues, largest first, of [[a, b, c], [b, d, e], [c, e, f]] (M7), by the angle of the cubic's roots."""
    q = (a + d + f) / 3
    off = b * b + c * c + e * e
    p = F.sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * off) / 6)
    r = clip(determinant([x / F.greatest(p, F.lit(1e-300)) for x in (a - q, b, c, b, d - q, e, c, e, f - q)]) / 2, -1.0, 1.0)
    angle = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + F.lit(2.0943951023931953))
    return [high, 3 * q - high - low, low]


def cosine_distance(a: str, b: str) -> Column:
    """1 - the dot product of two unit descriptors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def inverse(m: list[Column]) -> tuple[Column, list[Column]]:
    """The determinant and the inverse of any 4 x 4 matrix, from the 2 x 2 minors of its upper and lower rows; a singular one has nulls (M6)."""
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    up = [m[i] * m[4 + j] - m[j] * m[4 + i] for i, j in pairs]
    low = [m[8 + i] * m[12 + j] - m[8 + j] * m[12 + i] for i, j in pairs]
    det = up[0] * low[5] - up[1] * low[4] + up[2] * low[3] + up[3] * low[2] - up[4] * low[1] + up[5] * low[0]
    at = {p: k for k, p in enumerate(pairs)}
    out = []
    for i in range(4):  # entry (i, j) is the signed minor without row j and column i
        for j in range(4):
            cols = [c for c in range(4) if c != i]
            rest, minors = (1 - j, low) if j < 2 else (5 - j, up)
            terms = [m[4 * rest + c] * minors[at[tuple(x for x in cols if x != c)]] for c in cols]
            minor = terms[0] - terms[1] + terms[2]
            out.append((-minor if (i + j) % 2 else minor) / F.when(F.abs(det) > 1e-300, det))
    return det, out
