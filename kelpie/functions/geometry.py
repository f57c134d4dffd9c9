"""Poses, rotations and fisheye cameras as column expressions. A quaternion is a struct (x, y, z, w), a rotation an array
of nine (row by row), a rigid transform an array of sixteen, a vector an array of three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, where body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quaternion_norm(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])


def unit_quaternion(q: Column) -> Column:
    """q at length 1; nulls for the zero quaternion."""
    n = quaternion_norm(q)
    return F.struct(*[F.when(n > 0, q[k] / n).alias(k) for k in ("x", "y", "z", "w")])


def quaternion_to_rotation(q: Column) -> Column:
    """Nine doubles; null for the zero quaternion."""
    return let(q, lambda q: let(unit_quaternion(q), _to_rotation))


def _to_rotation(q: Column) -> Column:
    x, y, z, w = (q[k] for k in ("x", "y", "z", "w"))
    rows = [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]
    return F.when(x.isNotNull(), F.array(*rows))


def rotation_to_quaternion(r: Column) -> Column:
    """The largest of the four components is found first, which keeps the division well away from 0; w >= 0."""
    return let(r, lambda r: _rotation_to_quaternion(r))


def _rotation_to_quaternion(r: Column) -> Column:
    m = [F.element_at(r, i + 1) for i in range(9)]
    four = F.array(m[0] + m[4] + m[8], m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4])
    best = F.array_position(four, F.array_max(four))
    s = 2 * F.sqrt(1 + F.array_max(four))
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    d, e, f = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    q = lambda x, y, z, w: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))
    out = F.when(best == 1, q(a / s, b / s, c / s, s / 4)).when(best == 2, q(s / 4, d / s, e / s, a / s)).when(best == 3, q(d / s, s / 4, f / s, b / s)).otherwise(q(e / s, f / s, s / 4, c / s))
    sign = F.when(out["w"] < 0, -1.0).otherwise(1.0)
    return q(*[out[k] * sign for k in ("x", "y", "z", "w")])


def transform(r: Column, t: Column) -> Column:
    """Sixteen doubles from a rotation and a translation."""
    return let(r, lambda r: let(t, lambda t: _transform(r, t)))


def _transform(r: Column, t: Column) -> Column:
    e = F.element_at
    return F.array(e(r, 1), e(r, 2), e(r, 3), e(t, 1), e(r, 4), e(r, 5), e(r, 6), e(t, 2), e(r, 7), e(r, 8), e(r, 9), e(t, 3), *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def rotation_of(m: Column) -> Column:
    return let(m, lambda m: F.array(*[F.element_at(m, i) for i in (1, 2, 3, 5, 6, 7, 9, 10, 11)]))


def translation_of(m: Column) -> Column:
    return let(m, lambda m: F.array(*[F.element_at(m, i) for i in (4, 8, 12)]))


def times(a: Column, b: Column) -> Column:
    """Product of two rotations."""
    return let(a, lambda p: let(b, lambda q: _times(p, q)))


def _times(a: Column, b: Column) -> Column:
    x, y = ([F.element_at(v, i + 1) for i in range(9)] for v in (a, b))
    return F.array(*[x[3 * i] * y[j] + x[3 * i + 1] * y[3 + j] + x[3 * i + 2] * y[6 + j] for i in range(3) for j in range(3)])


def transposed(r: Column) -> Column:
    return F.array(*[F.element_at(r, i) for i in (1, 4, 7, 2, 5, 8, 3, 6, 9)])


def applied(r: Column, v: Column) -> Column:
    return let(r, lambda p: let(v, lambda q: _applied(p, q)))


def _applied(r: Column, v: Column) -> Column:
    m, x = [F.element_at(r, i + 1) for i in range(9)], [F.element_at(v, i + 1) for i in range(3)]
    return F.array(*[m[3 * i] * x[0] + m[3 * i + 1] * x[1] + m[3 * i + 2] * x[2] for i in range(3)])


def inverse(m: Column) -> Column:
    """Of a rigid transform: the transposed rotation, and -R' t."""
    return let(m, lambda m: _inverse(m))


def _inverse(m: Column) -> Column:
    back = lambda r: let(applied(r, translation_of(m)), lambda t: transform(r, F.array(*[-F.element_at(t, i) for i in (1, 2, 3)])))
    return let(transposed(rotation_of(m)), back)


def composed(a: Column, b: Column) -> Column:
    """Product of two rigid transforms: b first, then a."""
    return let(a, lambda a: let(b, lambda b: _composed(a, b)))


def _composed(a: Column, b: Column) -> Column:
    moved = applied(rotation_of(a), translation_of(b))
    at = F.array(*[F.element_at(moved, i) + F.element_at(translation_of(a), i) for i in (1, 2, 3)])
    return transform(times(rotation_of(a), rotation_of(b)), at)


def gl_to_cv(m: Column) -> Column:
    """A camera-to-world pose with y up and z back as one with y down and z forward, and the other way round."""
    return let(m, lambda m: _gl_to_cv(m))


def _gl_to_cv(m: Column) -> Column:
    return F.array(*[(-F.element_at(m, i) if i in (2, 3, 6, 7, 10, 11) else F.element_at(m, i)) for i in range(1, 17)])


def rotation_angle(a: Column, b: Column) -> Column:
    """Radians between two rotations, from sine and cosine, so small angles keep their digits."""
    return let(times(transposed(a), b), _angle)


def _angle(r: Column) -> Column:
    m = [F.element_at(r, i + 1) for i in range(9)]
    sine = F.sqrt(F.pow(m[7] - m[5], 2) + F.pow(m[2] - m[6], 2) + F.pow(m[3] - m[1], 2)) / 2
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2))
    return F.atan2(sine, cosine)


def is_rigid(m: Column, tolerance: float = 1e-6) -> Column:
    """Sixteen finite numbers, last row 0 0 0 1, an orthonormal rotation with determinant 1."""
    return let(m, lambda m: _is_rigid(m, tolerance))


def _is_rigid(m: Column, tolerance: float = 1e-6) -> Column:
    finite = (F.size(m) == 16) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    r = rotation_of(m)
    e = [F.element_at(r, i + 1) for i in range(9)]
    det = e[0] * (e[4] * e[8] - e[5] * e[7]) - e[1] * (e[3] * e[8] - e[5] * e[6]) + e[2] * (e[3] * e[7] - e[4] * e[6])
    p = times(transposed(r), r)
    near = F.abs(det - 1) <= tolerance
    for i in range(9):
        near = near & (F.abs(F.element_at(p, i + 1) - float(i % 4 == 0)) <= tolerance)
    last = (F.element_at(m, 13) == 0) & (F.element_at(m, 14) == 0) & (F.element_at(m, 15) == 0) & (F.element_at(m, 16) == 1)
    return F.coalesce(F.when(finite, near & last), F.lit(False))


def slerp(a: Column, b: Column, f: Column) -> Column:
    """Between unit quaternions, along the shorter arc."""
    keys = ("x", "y", "z", "w")
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = angle < 1e-9
    wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * angle) / F.sin(angle))
    wb = F.when(near, f).otherwise(F.sin(f * angle) / F.sin(angle))
    return F.struct(*[(wa * a[k] + wb * sign * b[k]).alias(k) for k in keys])


def quaternion_angle(a: Column, b: Column) -> Column:
    """The angle of the turn from one unit quaternion to another."""
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    i = a["w"] * b["x"] - a["x"] * b["w"] - a["y"] * b["z"] + a["z"] * b["y"]
    j = a["w"] * b["y"] + a["x"] * b["z"] - a["y"] * b["w"] - a["z"] * b["x"]
    k = a["w"] * b["z"] - a["x"] * b["y"] + a["y"] * b["x"] - a["z"] * b["w"]
    return 2 * F.atan2(F.sqrt(i * i + j * j + k * k), F.abs(dot))


def mean_quaternion(a: Column, b: Column) -> Column:
    """Of two: the second with the first's sign, added and scaled to length 1."""
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"] + a["w"] * b["w"]
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    s = F.struct(*[(a[k] + sign * b[k]).alias(k) for k in ("x", "y", "z", "w")])
    n = quaternion_norm(s)
    return F.struct(*[(s[k] / n).alias(k) for k in ("x", "y", "z", "w")])


def axis_angle_rotation(v: Column) -> Column:
    """Rodrigues' formula, with the series near 0."""
    return let(v, lambda v: let(F.sqrt(sum((F.element_at(v, i) * F.element_at(v, i) for i in (2, 3)), F.element_at(v, 1) * F.element_at(v, 1))), lambda a: let(_sines(a), lambda k: _turned(v, k))))


def _sines(a: Column) -> Column:
    """sin(a) / a and (1 - cos(a)) / a^2."""
    small = a < 1e-6
    s = F.when(small, 1 - a * a / 6).otherwise(F.sin(a) / a)
    c = F.when(small, 0.5 - a * a / 24).otherwise((1 - F.cos(a)) / (a * a))
    return F.struct(s.alias("s"), c.alias("c"))


def _turned(v: Column, k: Column) -> Column:
    x, y, z = (F.element_at(v, i) for i in (1, 2, 3))
    s, c = k["s"], k["c"]
    return F.array(
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )


def about_pivot(v: Column, t: Column, pivot: Column) -> Column:
    """The transform that turns by axis-angle v about pivot and moves by t."""
    moved = lambda turned: F.array(*[F.element_at(pivot, i) - F.element_at(turned, i) + F.element_at(t, i) for i in (1, 2, 3)])
    return let(axis_angle_rotation(v), lambda r: let(applied(r, pivot), lambda turned: transform(r, moved(turned))))


def to_camera(p: Column, m: Column) -> Column:
    """World point -> camera coordinates, by a camera-to-world pose."""
    return let(m, lambda m: applied(transposed(rotation_of(m)), F.array(*[F.element_at(p, i) - F.element_at(translation_of(m), i) for i in (1, 2, 3)])))


# --- fisheye -----------------------------------------------------------------------------------------------------------


def theta_d(theta: Column, k: list[float]) -> Column:
    t2 = theta * theta
    return theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))


def project(x: Column, y: Column, z: Column, f: tuple[float, float], c: tuple[float, float], k: list[float], ranges: tuple[float, float], max_theta: float) -> Column:
    """struct(u, v, range, theta, valid): a four-coefficient fisheye, theta = atan2(hypot(x, y), z)."""
    radial = F.hypot(x, y)
    theta = F.atan2(radial, z)
    scale = F.when(radial > 1e-12, theta_d(theta, k) / F.when(radial > 1e-12, radial)).otherwise(0.0)
    distance = F.sqrt(x * x + y * y + z * z)
    u, v = f[0] * x * scale + c[0], f[1] * y * scale + c[1]
    valid = (distance >= ranges[0]) & (distance <= ranges[1]) & (theta <= max_theta) & ~F.isnan(u) & ~F.isnan(v)
    return F.struct(u.alias("u"), v.alias("v"), distance.alias("range"), theta.alias("theta"), F.coalesce(valid, F.lit(False)).alias("valid"))


def unproject(u: Column, v: Column, f: tuple[float, float], c: tuple[float, float], k: list[float], iterations: int = 12) -> Column:
    """The unit ray (x, y, z) of a pixel: a fixed number of Newton steps for theta, folded in the row."""
    mx, my = (u - c[0]) / f[0], (v - c[1]) / f[1]
    rd = F.hypot(mx, my)

    def step(theta, _):
        t2 = theta * theta
        slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
        return theta - (theta_d(theta, k) - rd) / slope

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), rd, step)
    scale = F.when(rd > 1e-12, F.sin(theta) / F.when(rd > 1e-12, rd)).otherwise(1.0)
    return F.struct((mx * scale).alias("x"), (my * scale).alias("y"), F.cos(theta).alias("z"))


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def pixel_index(u: Column, v: Column, width: int) -> Column:
    """Row-major index of the nearest pixel, halves to even."""
    return (F.rint(v) * width + F.rint(u)).cast("bigint")


def in_fisheye_circle(px: Column, py: Column, f: tuple[float, float], c: tuple[float, float], k: list[float], max_theta: float) -> Column:
    return F.hypot((px - c[0]) / f[0], (py - c[1]) / f[1]) <= theta_d(F.lit(float(max_theta)), k)


def radius_px(f: tuple[float, float], k: list[float], theta: Column) -> Column:
    return 0.5 * (f[0] + f[1]) * theta_d(theta, k)


def depth_confidence(error_px: Column, support: Column, sigma: float = 0.75, full: int = 3) -> Column:
    return F.exp(-(error_px * error_px) / (2 * sigma * sigma)) * F.least(F.lit(1.0), F.log1p(support) / F.log1p(F.lit(float(full))))


def cropped_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, left: int, top: int, factor: int) -> Column:
    """Focal lengths and centre after a crop and a reduction by factor (1, 2 or 4)."""
    if factor not in (1, 2, 4):
        raise ValueError("factor must be 1, 2 or 4")
    return F.struct((fx / factor).alias("fx"), (fy / factor).alias("fy"), ((cx - left) / factor).alias("cx"), ((cy - top) / factor).alias("cy"))
