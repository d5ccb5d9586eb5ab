"""Camera and triangle geometry. Conventions: x_cam = R·X + t, R row-major in 9 numbers, depth = z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDISTORT_STEPS = 12


def to_camera(x, y, z, rotation: Column, translation: Column) -> list[Column]:
    """Camera-frame coordinates of a world point."""
    return [rotation[3 * i] * x + rotation[3 * i + 1] * y + rotation[3 * i + 2] * z + translation[i] for i in range(3)]


def project(x, y, z, rotation, translation, focal, cx, cy, k1) -> Column:
    """``struct(u, v, z)`` under the one-coefficient radial model; callers gate on z."""
    xc, yc, zc = to_camera(x, y, z, rotation, translation)
    safe = F.when(zc > 1e-9, zc).otherwise(1.0)
    xn, yn = xc / safe, yc / safe
    bend = 1 + k1 * (xn * xn + yn * yn)
    return F.struct((focal * xn * bend + cx).alias("u"), (focal * yn * bend + cy).alias("v"), zc.alias("z"))


def undistort(u, v, focal, cx, cy, k1) -> Column:
    """``struct(x, y)``: normalised coordinates of a pixel, by fixed-point steps."""
    xd, yd = (u - cx) / focal, (v - cy) / focal

    def step(s, _):
        bend = 1 + k1 * (s["x"] * s["x"] + s["y"] * s["y"])
        return F.struct((xd / bend).alias("x"), (yd / bend).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(UNDISTORT_STEPS)), F.struct(xd.alias("x"), yd.alias("y")), step)


def backproject(u, v, depth, rotation, translation, focal, cx, cy, k1) -> Column:
    """``struct(x, y, z)``: world point of a pixel at an optical-axis depth."""
    n = undistort(u, v, focal, cx, cy, k1)
    local = [n["x"] * depth - translation[0], n["y"] * depth - translation[1], depth - translation[2]]
    axes = [rotation[i] * local[0] + rotation[3 + i] * local[1] + rotation[6 + i] * local[2] for i in range(3)]
    return F.struct(*[a.alias(n) for a, n in zip(axes, "xyz")])


def centre(rotation: Column, translation: Column) -> Column:
    """Camera centre −Rᵀt as an array of three."""
    return F.array(
        *[-(rotation[i] * translation[0] + rotation[3 + i] * translation[1] + rotation[6 + i] * translation[2]) for i in range(3)]
    )


def optical_axis(rotation: Column) -> Column:
    """Viewing direction in world coordinates."""
    return F.array(rotation[6], rotation[7], rotation[8])


def azimuth(x, y) -> Column:
    return F.degrees(F.atan2(y, x))


def elevation(x, y, z) -> Column:
    return F.degrees(F.atan2(z, F.greatest(F.sqrt(x * x + y * y), F.lit(1e-9))))


def look_at_cosine(cx, cy, cz, dx, dy, dz, ox, oy, oz) -> Column:
    """Cosine between the viewing direction and the direction to the object centre."""
    px, py, pz = ox - cx, oy - cy, oz - cz
    size = F.sqrt(px * px + py * py + pz * pz) * F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.when(size > 1e-12, (px * dx + py * dy + pz * dz) / size)


def circular_distance(a, b) -> Column:
    """Shorter way round between two angles in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def face_normal(p, q, r) -> list[Column]:
    """Unscaled normal of the triangle p, q, r (lists of three columns)."""
    return cross([q[i] - p[i] for i in range(3)], [r[i] - p[i] for i in range(3)])


def symmetric_eigenvalues(m) -> list[Column]:
    """Eigenvalues, largest first, of [[a,d,e],[d,b,f],[e,f,c]] given as (a,b,c,d,e,f)."""
    a, b, c, d, e, f = m
    mean = (a + b + c) / 3
    off = d * d + e * e + f * f
    p2 = (a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * off
    p = F.sqrt(p2 / 6)
    safe = F.when(p > 0, p).otherwise(1.0)
    ba, bb, bc = (a - mean) / safe, (b - mean) / safe, (c - mean) / safe
    bd, be, bf = d / safe, e / safe, f / safe
    half = (ba * (bb * bc - bf * bf) - bd * (bd * bc - bf * be) + be * (bd * bf - bb * be)) / 2
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    first = mean + 2 * p * F.cos(phi)
    last = mean + 2 * p * F.cos(phi + 2 * 3.141592653589793 / 3)
    return [first, 3 * mean - first - last, last]
