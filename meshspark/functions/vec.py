"""Vector and triangle functions as column expressions; a vector is a tuple of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def vec(prefix: str, axes: str = "xyz") -> Vec:
    return tuple(F.col(prefix + a) for a in axes)


def lit(*values: float) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return _sum([x * y for x, y in zip(a, b, strict=True)])


def mag2(a: Vec) -> Column:
    return dot(a, a)


def mag(a: Vec) -> Column:
    return F.sqrt(mag2(a))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a: Vec, b: Vec) -> Column:
    """The z part of the cross product of two plane vectors."""
    return a[0] * b[1] - a[1] * b[0]


def perpdot(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_column(low), F.least(as_column(high), x))


def normalize(a: Vec, eps: float = 1e-16) -> Vec:
    """Unit vector; vectors shorter than eps stay as they are."""
    size = mag2(a)
    length = F.when(size < eps, F.lit(1.0)).otherwise(F.sqrt(size))
    return tuple(x / length for x in a)


def ncross(a: Vec, b: Vec) -> Vec:
    return normalize(cross(a, b))


def cot(a: Vec, b: Vec) -> Column:
    """Cotangent of the angle between a and b; null where they are parallel."""
    size = F.sqrt(F.greatest(mag2(a) * mag2(b) - dot(a, b) * dot(a, b), F.lit(0.0)))
    return ratio(dot(a, b), size)


def angle(a: Vec, b: Vec) -> Column:
    sizes = mag(a) * mag(b)
    return F.acos(clamp(ratio(dot(a, b), sizes), -1.0, 1.0))


def angle_distance(a: Column, b: Column) -> Column:
    """The angle between two headings in radians, in [0, pi]."""
    return F.acos(clamp(F.cos(a) * F.cos(b) + F.sin(a) * F.sin(b), -1.0, 1.0))


def tri_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Area of a triangle in any dimension."""
    u, v = sub(b, a), sub(c, a)
    return 0.5 * F.sqrt(F.greatest(mag2(u) * mag2(v) - dot(u, v) * dot(u, v), F.lit(0.0)))


def tri_area_signed(a: Vec, b: Vec, c: Vec) -> Column:
    return 0.5 * cross2(sub(b, a), sub(c, a))


def tri_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return ncross(sub(b, a), sub(c, a))


def tri_obtuse(a: Vec, b: Vec, c: Vec) -> Column:
    return (dot(sub(b, a), sub(c, a)) < 0) | (dot(sub(a, b), sub(c, b)) < 0) | (dot(sub(a, c), sub(b, c)) < 0)


def tri_gradients(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Vec, Vec]:
    """Gradients of the three barycentric coordinates over a triangle in space."""
    normal = cross(sub(b, a), sub(c, a))
    size = mag2(normal)
    at = lambda edge: tuple(ratio(x, size) for x in cross(normal, edge))
    return at(sub(c, b)), at(sub(a, c)), at(sub(b, a))


def matvec(m: Sequence[Column], a: Vec) -> Vec:
    """Product of a row-major matrix with a vector."""
    n = len(a)
    return tuple(dot(tuple(m[r * n : (r + 1) * n]), a) for r in range(len(m) // n))


def axis_rotation(axis: Vec, theta: Column) -> list[Column]:
    """Row-major rotation about a unit axis."""
    x, y, z = axis
    c, s = F.cos(theta), F.sin(theta)
    d = 1 - c
    return [c + x * x * d, x * y * d - z * s, x * z * d + y * s, y * x * d + z * s, c + y * y * d, y * z * d - x * s, z * x * d - y * s, z * y * d + x * s, c + z * z * d]


def align(a: Vec, b: Vec, side: Vec) -> list[Column]:
    """Row-major rotation that takes unit vector a to unit vector b; for opposite ones half a turn about ``side``, a unit
    normal of a, best a projected column of ``tangent_frame`` since it is used many times."""
    v, c = cross(a, b), dot(a, b)
    k = ratio(F.lit(1.0), 1 + c)
    general = [v[i] * v[j] * k + (c if i == j else (F.lit(0.0))) for i in range(3) for j in range(3)]
    skew = [F.lit(0.0), -v[2], v[1], v[2], F.lit(0.0), -v[0], -v[1], v[0], F.lit(0.0)]
    half = [2 * side[i] * side[j] - (1.0 if i == j else 0.0) for i in range(3) for j in range(3)]
    return [F.when(c < -1 + 1e-12, h).otherwise(g + s) for g, s, h in zip(general, skew, half, strict=True)]


def tangent_frame(n: Vec) -> tuple[Vec, Vec]:
    """Two unit tangents of a unit normal; the first is normal to the normal's largest part."""
    ax, ay, az = (F.abs(x) for x in n)
    zero = F.lit(0.0)
    by_x, by_y, by_z = (-n[1], n[0], zero), (-n[1], n[0], zero), (zero, -n[2], n[1])
    first = normalize(tuple(F.when((ax >= ay) & (ax >= az), x).when(ay >= az, y).otherwise(z) for x, y, z in zip(by_x, by_y, by_z, strict=True)))
    return first, cross(n, first)


def to_spherical(p: Vec) -> Vec:
    """(radius, polar angle from +z, azimuth)."""
    r = mag(p)
    return r, F.when(r > 0, F.acos(clamp(ratio(p[2], r), -1.0, 1.0))).otherwise(0.0), F.atan2(p[1], p[0])


def from_spherical(r: Column, polar: Column, azimuth: Column) -> Vec:
    return r * F.sin(polar) * F.cos(azimuth), r * F.sin(polar) * F.sin(azimuth), r * F.cos(polar)


def circle_centres(a: Vec, b: Vec, r: Column) -> tuple[Vec, Vec]:
    """Centres of the two circles of radius r through two plane points; null where they are too far apart."""
    d = sub(b, a)
    size = mag2(d)
    off = r * r - size / 4
    h = F.when((size > 0) & (off >= 0), F.sqrt(F.greatest(off, F.lit(0.0)) / size))
    mid = scale(add(a, b), 0.5)
    return (mid[0] - h * d[1], mid[1] + h * d[0]), (mid[0] + h * d[1], mid[1] - h * d[0])


def line_circle(p: Vec, direction: Vec, centre: Vec, r: Column) -> tuple[Column, Column]:
    """The two parameters at which a plane line meets a circle, the smaller first; null where it does not."""
    w = sub(p, centre)
    a, b, c = mag2(direction), dot(w, direction), mag2(w) - r * r
    inside = b * b - a * c
    root = F.when((a > 0) & (inside >= 0), F.sqrt(F.greatest(inside, F.lit(0.0))))
    return (-b - root) / a, (-b + root) / a


def plane_distance(p: Vec, origin: Vec, normal: Vec) -> Column:
    return dot(sub(p, origin), normal)


def sphere_distance(p: Vec, centre: Vec, r: Column | float) -> Column:
    return mag(sub(p, centre)) - r


def gaussian_ratio(x: Column, sd: float) -> Column:
    """Normal density of mean 0 over its mode."""
    return F.exp(-x * x / (2 * sd * sd))


def chi2_quantile_2(p: Column) -> Column:
    """Quantile of the chi-squared law with two degrees of freedom."""
    return -2 * F.log(1 - p)


def closest_on_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> tuple[Column, Vec]:
    """(squared distance, closest point) from p to the triangle abc: the least over its inside and its three edges."""
    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    den = d00 * d11 - d01 * d01
    v, w = ratio(d11 * d20 - d01 * d21, den), ratio(d00 * d21 - d01 * d20, den)
    inside = F.coalesce((v >= 0) & (w >= 0) & (v + w <= 1), F.lit(False))
    foot = add(a, add(scale(ab, v), scale(ac, w)))

    def on_edge(s: Vec, e: Vec) -> Vec:
        d = sub(e, s)
        t = clamp(F.coalesce(ratio(dot(sub(p, s), d), mag2(d)), F.lit(0.0)), 0.0, 1.0)
        return add(s, scale(d, t))

    spots = [on_edge(a, b), on_edge(b, c), on_edge(c, a)]
    gaps = [mag2(sub(p, s)) for s in spots]
    least = F.least(*gaps)
    edge = tuple(F.when(gaps[0] == least, x).when(gaps[1] == least, y).otherwise(z) for x, y, z in zip(*spots, strict=True))
    point = tuple(F.when(inside, x).otherwise(y) for x, y in zip(foot, edge, strict=True))
    return F.when(inside, mag2(sub(p, foot))).otherwise(least), point


def turning(total_angle: Column) -> Column:
    """Turning number of a closed polygon from the sum of its exterior angles."""
    return F.round(total_angle / (2 * math.pi))


def other_corners(corners: list[Column], k: Column) -> tuple[Column, Column]:
    """The two corners after corner ``k`` (from 0), in the face's own turn."""
    around = F.array(*corners)
    return F.get(around, (k + 1) % 3), F.get(around, (k + 2) % 3)


def third_corner(corners: list[Column], a: Column, b: Column) -> Column:
    """The corner that is neither ``a`` nor ``b``; null where these are not two corners of the face."""
    left = F.filter(F.array(*corners), lambda v: (v != a) & (v != b))
    return F.when(F.size(left) == 1, F.get(left, F.lit(0)))


def ramp(t: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Vec:
    """The colour at ``t`` of [0, 1] on the line between two; beyond the ends, the ends."""
    s = clamp(t, 0.0, 1.0)
    return tuple(F.lit(a) + s * (b - a) for a, b in zip(low, high, strict=True))


def to_spherical_azimuth(p: Vec) -> Vec:
    """(azimuth, polar angle from +z, radius), the convention that names the azimuth first."""
    r, polar, azimuth = to_spherical(p)
    return azimuth, polar, r


def from_spherical_azimuth(azimuth: Column, polar: Column, r: Column) -> Vec:
    return from_spherical(r, polar, azimuth)


def sphere_normal_coordinates(radius: Column | float, p: Vec, q: Vec, first: Vec, second: Vec) -> tuple[Column, Column]:
    """(u, v) of q in the tangent plane at p of a sphere about the origin: as long as the great circle from p to q, in the
    direction of p - q by the tangents ``first`` and ``second``; zero where p and q meet."""
    gap = sub(p, q)
    r = angle(p, q) * radius
    theta = F.atan2(dot(gap, second), dot(gap, first))
    same = mag(gap) < math.sqrt(2.220446049250313e-16)
    return F.when(same, 0.0).otherwise(r * F.cos(theta)), F.when(same, 0.0).otherwise(r * F.sin(theta))
