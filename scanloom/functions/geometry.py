"""Cells, keys, rigid transforms, rotations and colours as Catalyst expressions.

Nothing here is a Python function of the data: every helper builds columns, so
whole-stage code generation covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

#: Bits of a coordinate in a packed or Morton key, and the bias that makes it non-negative.
KEY_BITS, KEY_BIAS = 21, 1 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def cell(value: Column, resolution: float) -> Column:
    """floor(value / resolution); exact for resolutions that are powers of two."""
    return F.floor(_c(value) / F.lit(float(resolution))).cast("int")


def cells(x, y, z, resolution: float) -> Triple:
    return cell(_c(x), resolution), cell(_c(y), resolution), cell(_c(z), resolution)


def pack_key(vx: Column, vy: Column, vz: Column) -> Column:
    """Three biased 21-bit coordinates in one BIGINT, z highest."""
    part = lambda v, at: F.shiftleft(F.col(v).cast("long") + KEY_BIAS if isinstance(v, str) else v.cast("long") + KEY_BIAS, at)
    return part(vz, 2 * KEY_BITS).bitwiseOR(part(vy, KEY_BITS)).bitwiseOR(part(vx, 0))


def unpack_key(key: Column) -> Triple:
    mask = (1 << KEY_BITS) - 1
    part = lambda at: (F.shiftright(_c(key), at).bitwiseAND(F.lit(mask).cast("long")) - KEY_BIAS).cast("int")
    return part(0), part(KEY_BITS), part(2 * KEY_BITS)


def linear_id(vx: Column, vy: Column, vz: Column, dx: Column, dy: Column) -> Column:
    """x + y*dx + z*dx*dy of coordinates counted from the lower bound."""
    return (_c(vx) + _c(vy) * _c(dx) + _c(vz) * _c(dx) * _c(dy)).cast("long")


def from_linear_id(i: Column, dx: Column, dy: Column) -> Triple:
    i, dx, dy = _c(i).cast("long"), _c(dx).cast("long"), _c(dy).cast("long")
    return (i % dx).cast("int"), (F.floor(i / dx) % dy).cast("int"), F.floor(i / (dx * dy)).cast("int")


def _masks(bits: int) -> list[tuple[int, int]]:
    """(shift, mask) that spread a number's bits to every third place, by halving groups."""
    out, group = [], 1 << (bits - 1).bit_length()
    while group > 1:
        group //= 2
        mask = 0
        for start in range(0, bits, group):
            for bit in range(start, min(start + group, bits)):
                mask |= 1 << (bit + 2 * start)
        out.append((2 * group, mask & ((1 << 63) - 1)))
    return out


def spread_bits(v: Column) -> Column:
    """The 21 low bits at places 0, 3, 6, ..."""
    v = _c(v).cast("long").bitwiseAND(F.lit((1 << KEY_BITS) - 1).cast("long"))
    for shift, mask in _masks(KEY_BITS):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def gather_bits(v: Column) -> Column:
    """The inverse of spread_bits."""
    steps = _masks(KEY_BITS)
    v = _c(v).bitwiseAND(F.lit(steps[-1][1]).cast("long"))
    for (shift, _), (_, mask) in zip(reversed(steps), [*reversed(steps[:-1]), (0, (1 << KEY_BITS) - 1)], strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(vx: Column, vy: Column, vz: Column) -> Column:
    """63-bit Z-order code of non-negative coordinates, clamped to 21 bits each."""
    clamp = lambda v: F.least(F.greatest(_c(v).cast("long"), F.lit(0).cast("long")), F.lit((1 << KEY_BITS) - 1).cast("long"))
    return spread_bits(clamp(vx)).bitwiseOR(F.shiftleft(spread_bits(clamp(vy)), 1)).bitwiseOR(F.shiftleft(spread_bits(clamp(vz)), 2))


def unmorton(code: Column) -> Triple:
    return gather_bits(_c(code)), gather_bits(F.shiftright(_c(code), 1)), gather_bits(F.shiftright(_c(code), 2))


def rotation_xyz(roll, pitch, yaw) -> list[list[Column]]:
    """The matrix Rx(roll) Ry(pitch) Rz(yaw), the convention of the optimiser."""
    sr, cr, sp, cp, sy, cy = (f(_c(a)) for a in (roll, pitch, yaw) for f in (F.sin, F.cos))
    return [
        [cp * cy, -cp * sy, sp],
        [sr * sp * cy + cr * sy, cr * cy - sr * sp * sy, -sr * cp],
        [sr * sy - cr * sp * cy, cr * sp * sy + sr * cy, cr * cp],
    ]


def rotation_quaternion(qx, qy, qz, qw) -> list[list[Column]]:
    x, y, z, w = map(_c, (qx, qy, qz, qw))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def apply_rigid(matrix: list[list[Column]], point, shift) -> Triple:
    """matrix * point + shift."""
    p, t = [_c(v) for v in point], [_c(v) for v in shift]
    rows = [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + s for r, s in zip(matrix, t, strict=True)]
    return rows[0], rows[1], rows[2]


def rpy_to_quaternion(roll, pitch, yaw) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w of Rz(yaw) Ry(pitch) Rx(roll), the convention of stored poses."""
    half = [_c(a) / 2 for a in (roll, pitch, yaw)]
    (sr, sp, sy), (cr, cp, cy) = [F.sin(a) for a in half], [F.cos(a) for a in half]
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def quaternion_to_rpy(qx, qy, qz, qw) -> Triple:
    x, y, z, w = map(_c, (qx, qy, qz, qw))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(sine), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def xyz_to_quaternion(roll, pitch, yaw) -> tuple[Column, Column, Column, Column]:
    """x, y, z, w of Rx(roll) Ry(pitch) Rz(yaw), the convention of the optimiser."""
    zero = F.lit(0.0)
    turns = []
    for axis, angle in enumerate((roll, pitch, yaw)):
        half = _c(angle) / 2
        turns.append((*(F.sin(half) if k == axis else zero for k in range(3)), F.cos(half)))
    return quaternion_multiply(quaternion_multiply(turns[0], turns[1]), turns[2])


def quaternion_to_xyz(qx, qy, qz, qw) -> Triple:
    """roll, pitch, yaw of Rx Ry Rz."""
    m = rotation_quaternion(qx, qy, qz, qw)
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[0][2]))
    return F.atan2(-m[1][2], m[2][2]), F.asin(sine), F.atan2(-m[0][1], m[0][0])


def quaternion_multiply(a, b) -> tuple[Column, Column, Column, Column]:
    ax, ay, az, aw = map(_c, a)
    bx, by, bz, bw = map(_c, b)
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def quaternion_inverse(q) -> tuple[Column, Column, Column, Column]:
    x, y, z, w = map(_c, q)
    return -x, -y, -z, w


def relative_pose(result, initial) -> tuple[Triple, tuple[Column, Column, Column, Column]]:
    """result * initial^-1, both as ((x, y, z), (qx, qy, qz, qw))."""
    turn = quaternion_multiply(result[1], quaternion_inverse(initial[1]))
    moved = apply_rigid(rotation_quaternion(*turn), initial[0], (0.0, 0.0, 0.0))
    return tuple(_c(r) - m for r, m in zip(result[0], moved, strict=True)), turn


def slerp(a, b, t) -> tuple[Column, Column, Column, Column]:
    """Along the shorter arc; linear where the arc is tiny."""
    a, b, t = [_c(v) for v in a], [_c(v) for v in b], _c(t)
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    side = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    tiny = F.abs(dot) > 0.9999999
    wa = F.when(tiny, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(tiny, t).otherwise(F.sin(t * angle) / F.sin(angle)) * side
    return tuple(x * wa + y * wb for x, y in zip(a, b, strict=True))


def quaternion_angle(a, b) -> Column:
    dot = sum((_c(x) * _c(y) for x, y in zip(a[1:], b[1:], strict=True)), _c(a[0]) * _c(b[0]))
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot)))


def wrap_angle(a) -> Column:
    """Into [-pi, pi)."""
    turn = 2 * math.pi
    return _c(a) - F.floor((_c(a) + math.pi) / turn) * turn


def distance(a, b) -> Column:
    """Euclidean, of two or three dimensions."""
    squares = [(_c(x) - _c(y)) * (_c(x) - _c(y)) for x, y in zip(a, b, strict=True)]
    return F.sqrt(sum(squares[1:], squares[0]))


def add_pose(pose: Column, delta: Column, step: float = 1.0) -> Column:
    """Element-wise pose + step * delta of six-element arrays."""
    return F.zip_with(_c(pose), _c(delta), lambda p, d: p + F.lit(step) * d)


def score_color(score) -> tuple[Column, Column, Column, Column]:
    """A normalised score as red, green, blue and opacity: quarter waves over four ranges."""
    x = F.least(F.greatest(_c(score), F.lit(0.0)), F.lit(0.9999))
    wave = F.sin((x * 4 - F.floor(x * 4)) * (math.pi / 2))
    fall = F.cos((x * 4 - F.floor(x * 4)) * (math.pi / 2))
    pick = lambda *v: F.when(x < 0.25, v[0]).when(x < 0.5, v[1]).when(x < 0.75, v[2]).otherwise(v[3])
    zero, one = F.lit(0.0), F.lit(1.0)
    return pick(zero, zero, wave, one), pick(wave, one, one, fall), pick(one, fall, zero, zero), F.lit(0.999)


def normalised_score(score, low: float = 1.0, high: float = 3.5) -> Column:
    return F.lit(0.5) if high <= low else (_c(score) - low) / (high - low)


def pack_rgb(r, g, b) -> Column:
    """0x00RRGGBB with components cut (not rounded) to bytes."""
    byte = lambda v: F.floor(F.least(F.greatest(_c(v), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return F.shiftleft(byte(r), 16).bitwiseOR(F.shiftleft(byte(g), 8)).bitwiseOR(byte(b))


def hsv_to_rgb(h, s, v) -> Triple:
    """Hue in degrees, saturation and value in [0, 1]."""
    h, s, v = map(_c, (h, s, v))
    component = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least((h / 60 + n) % 6, 4 - (h / 60 + n) % 6, F.lit(1.0)))
    return component(5), component(3), component(1)


def stamp_to_ns(sec, nanosec) -> Column:
    return _c(sec).cast("long") * 1_000_000_000 + _c(nanosec).cast("long")


def ns_to_stamp(ns) -> tuple[Column, Column]:
    sec = (_c(ns) - F.pmod(_c(ns), F.lit(1_000_000_000))).cast("long") / F.lit(1_000_000_000)
    return sec.cast("int"), F.pmod(_c(ns), F.lit(1_000_000_000)).cast("int")
