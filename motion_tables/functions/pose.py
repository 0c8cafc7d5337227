"""Column functions on landmarks: lengths, angles, scales, validity.  Points are structs of x, y and, where three dimensions count, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places in the list of 21 landmarks.
NOSE, L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST = range(7)
L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE, L_FOOT, R_FOOT = range(13, 21)


def at(lm: Column, j: int) -> Column:
    return F.get(lm, F.lit(j))


def mid(a: Column, b: Column, axis: str) -> Column:
    return (a[axis] + b[axis]) / 2


def dot(u: list[Column], v: list[Column]) -> Column:
    out = u[0] * v[0]
    for a, b in zip(u[1:], v[1:]):
        out = out + a * b
    return out


def minus(a: Column, b: Column, axes: str = "xyz") -> list[Column]:
    return [a[k] - b[k] for k in axes]


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def body_scale(lm: Column) -> Column:
    """Distance of the shoulders' middle from the hips' middle in the image, at least 1e-6."""
    s, h = (at(lm, L_SHOULDER), at(lm, R_SHOULDER)), (at(lm, L_HIP), at(lm, R_HIP))
    return F.greatest(F.hypot(mid(*s, "x") - mid(*h, "x"), mid(*s, "y") - mid(*h, "y")), F.lit(1e-6))


def body_scale_3d(lm: Column) -> Column:
    """The same in space, at least 0.01."""
    s, h = (at(lm, L_SHOULDER), at(lm, R_SHOULDER)), (at(lm, L_HIP), at(lm, R_HIP))
    d = [mid(*s, k) - mid(*h, k) for k in "xyz"]
    return F.greatest(F.sqrt(dot(d, d)), F.lit(0.01))


def angle_3points(a: Column, b: Column, c: Column) -> Column:
    """Radians at b between a and c in space; lengths of zero give a right angle."""
    u, v = minus(a, b), minus(c, b)
    return F.acos(clipped(dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)) + 1e-8), -1.0, 1.0))


def included_angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b between a and c in the image; null where either is at b."""
    u, v = minus(a, b, "xy"), minus(c, b, "xy")
    length = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(length > 0, F.degrees(F.acos(clipped(dot(u, v) / length, -1.0, 1.0))))


def line_tilt(a: Column, b: Column) -> Column:
    """Radians of the line from a to b against the horizontal."""
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def elevation(a: Column, b: Column) -> Column:
    """Degrees of the line from a to b above the horizontal, -90 to 90; the image's y points down."""
    return F.degrees(F.atan2(a["y"] - b["y"], F.abs(b["x"] - a["x"])))


def spine_tilt(lm: Column) -> Column:
    """Radians of the line from the hips' to the shoulders' middle against the upright."""
    s, h = (at(lm, L_SHOULDER), at(lm, R_SHOULDER)), (at(lm, L_HIP), at(lm, R_HIP))
    d = [mid(*s, k) - mid(*h, k) for k in "xyz"]
    return F.acos(clipped(-d[1] / (F.sqrt(dot(d, d)) + 1e-8), -1.0, 1.0))


def angles(lm: Column) -> dict[str, Column]:
    """The seven joint and tilt angles of a frame, in radians."""
    j = lambda *ids: [at(lm, i) for i in ids]
    return {
        "spine_tilt": spine_tilt(lm),
        "shoulder_tilt": line_tilt(*j(L_SHOULDER, R_SHOULDER)),
        "hip_tilt": line_tilt(*j(L_HIP, R_HIP)),
        "left_elbow_angle": angle_3points(*j(L_SHOULDER, L_ELBOW, L_WRIST)),
        "right_elbow_angle": angle_3points(*j(R_SHOULDER, R_ELBOW, R_WRIST)),
        "left_knee_angle": angle_3points(*j(L_HIP, L_KNEE, L_ANKLE)),
        "right_knee_angle": angle_3points(*j(R_HIP, R_KNEE, R_ANKLE)),
    }


def normalized(lm: Column) -> Column:
    """All landmarks from the hips' middle, in units of the body scale in space."""
    h, scale = (at(lm, L_HIP), at(lm, R_HIP)), body_scale_3d(lm)
    return F.transform(lm, lambda q: F.struct(*[((q[k] - mid(*h, k)) / scale).alias(k) for k in "xyz"]))


def lead_arm_elevation(lm: Column, handedness: Column) -> Column:
    """Height of the lead wrist under the lead shoulder, in body scales; a right-hander leads with the left."""
    left = (at(lm, L_WRIST)["y"] - at(lm, L_SHOULDER)["y"]) / body_scale(lm)
    right = (at(lm, R_WRIST)["y"] - at(lm, R_SHOULDER)["y"]) / body_scale(lm)
    return F.when(handedness == "left", right).otherwise(left)


def sided(role: Column, joint: Column, handedness: Column) -> Column:
    """left_ or right_ joint for lead or trail."""
    left = (role == "lead") == (handedness == "right")
    return F.concat(F.when(left, "left_").otherwise("right_"), joint)


def interpolated(a: Column, b: Column, t: Column) -> Column:
    """Landmarks between two frames, at fraction t."""
    return F.zip_with(a, b, lambda p, q: F.struct(*[(p[k] + (q[k] - p[k]) * t).alias(k) for k in "xyz"]))


def wrap_degrees(a: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360)) - 180


def club_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees of a segment from the upright."""
    return F.degrees(F.atan2(F.abs(x2 - x1), F.abs(y2 - y1)))


def is_valid(detected: Column, x: Column, y: Column, conf: Column, least: Column) -> Column:
    """Whether a landmark counts as observed: an unknown confidence does."""
    return F.coalesce(detected, F.lit(False)) & x.isNotNull() & y.isNotNull() & (conf.isNull() | (conf >= least))


def slope_confidence(slope: Column) -> Column:
    return clipped(slope / 2, 0.0, 1.0)


def let(value: Column, then) -> Column:
    """then(value) with the value made once: an expression used many times over does not grow with every use."""
    return F.get(F.transform(F.array(value), then), 0)
