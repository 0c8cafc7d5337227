"""Measurements as long rows (key, value), a reason instead of a value where one is missing, and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions import pose as P


def long_form(df: DataFrame, measurements: dict[str, Column]) -> DataFrame:
    """One row for each measurement of a frame; user-defined measurements are columns like any other."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in measurements.items()])
    return df.select("video_id", "frame", F.explode(rows).alias("m")).select("video_id", "frame", "m.*")


def displacements(p: DataFrame, points: dict[str, int]) -> DataFrame:
    """dx, dy (up) of named points since the recording's first position (frame 0), in its body scales; null without a scale.  The reference is one row a recording."""
    lm = F.col("lm")
    s, h = (P.at(lm, P.L_SHOULDER), P.at(lm, P.R_SHOULDER)), (P.at(lm, P.L_HIP), P.at(lm, P.R_HIP))
    scale = F.hypot(P.mid(*s, "x") - P.mid(*h, "x"), P.mid(*s, "y") - P.mid(*h, "y"))
    ref = p.where("frame = 0").select("video_id", F.col("lm").alias("lm0"), scale.alias("scale"))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), P.at(lm, j).alias("q"), P.at(F.col("lm0"), j).alias("q0")) for k, j in points.items()])
    m = p.join(ref, "video_id").select("video_id", "frame", "scale", F.explode(rows).alias("m"))
    part = lambda d: F.when(F.col("scale") > 0, d / F.when(F.col("scale") > 0, F.col("scale")))
    return m.select("video_id", "frame", F.col("m.key").alias("key"), part(F.col("m.q.x") - F.col("m.q0.x")).alias("dx"), part(F.col("m.q0.y") - F.col("m.q.y")).alias("dy"))


def compared(user: DataFrame, ref: DataFrame) -> DataFrame:
    """Measurements of the same pair, frame and key, of the same view only: both values and user less reference."""
    u = user.select("pair_id", "view", "frame", "key", F.col("value").alias("user_value"))
    r = ref.select("pair_id", "view", "frame", "key", F.col("value").alias("ref_value"))
    return u.join(r, ["pair_id", "view", "frame", "key"]).withColumn("difference", F.col("user_value") - F.col("ref_value"))


@dataclass(frozen=True)
class Measurement:
    """A measurement of one frame: its key and label, the points that it needs (columns of structs with x and y, null where not detected), the view that it makes sense in (None: any), and its value from those points."""

    key: str
    label: str
    joints: tuple[str, ...]
    value: Callable[..., Column]
    view: str | None = None


class Measurements:
    """A catalog of measurements that users add to."""

    def __init__(self):
        self.all: dict[str, Measurement] = {}

    def add(self, key: str, label: str, joints: Iterable[str], view: str | None = None):
        """Registers the decorated function, which gets a column for each of ``joints``, under a key of its own."""
        joints = tuple(joints)
        if key in self.all or not joints:
            raise ValueError(f"measurement {key!r} is there already" if joints else f"measurement {key!r} needs a point")

        def mark(f: Callable[..., Column]) -> Callable[..., Column]:
            self.all[key] = Measurement(key, label, joints, f, view)
            return f

        return mark

    def measured(self, points: DataFrame) -> DataFrame:
        """video_id, frame, key, value, reason of every frame of ``points`` (video_id, frame, view and the joints' columns) and every measurement of its view.

        A value that needs a point which isn't detected is null, with the reason naming the missing ones; so is one that its function leaves null or not a number.  All measurements of a frame
        come from one row, without a shuffle.  An empty catalog gives an empty result.
        """
        if not self.all:
            return points.select("video_id", "frame", F.lit("").alias("key"), F.lit(0.0).alias("value"), F.lit("").alias("reason")).limit(0)
        rows = []
        for m in self.all.values():
            missing = F.array_compact(F.array(*[F.when(F.col(j).isNull(), F.lit(j)) for j in m.joints]))
            value = m.value(*[F.col(j) for j in m.joints]).cast("double")
            value = F.when((F.size(missing) == 0) & ~F.isnan(value), value)
            reason = F.when(F.size(missing) > 0, F.concat(F.lit("not detected: "), F.array_join(missing, ", "))).when(value.isNull(), "undefined")
            row = F.struct(F.lit(m.key).alias("key"), value.alias("value"), reason.alias("reason"))
            rows.append(row if m.view is None else F.when(F.col("view") == m.view, row))
        return points.select("video_id", "frame", F.explode(F.array_compact(F.array(*rows))).alias("m")).select("video_id", "frame", "m.*")


# The shortest segment that has a direction, in pixels; least width of the shoulders and of the cue that orients a view, in torso lengths.
LEAST_PX, LEAST_SHOULDERS, LEAST_CUE = 1e-6, 0.2, 0.05
JOINTS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")
CENTRES = ("head", "shoulders", "hips", "lead_wrist", "trail_wrist", "hands")


def _middle(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))


def _length(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def named(points: DataFrame) -> DataFrame:
    """points (video_id, frame, view dtl or face_on, handedness, and a struct of x, y for each of left_ear, right_ear and both sides of JOINTS, null where not detected) with lead_ and trail_ joints, the tracked centres and the torso's length."""
    right = F.col("handedness") == "right"
    out = points
    for j in JOINTS:
        left, other = F.col(f"left_{j}"), F.col(f"right_{j}")
        out = out.withColumn(f"lead_{j}", F.when(right, left).otherwise(other)).withColumn(f"trail_{j}", F.when(right, other).otherwise(left))
    out = out.withColumns({"c_head": _middle(F.col("left_ear"), F.col("right_ear")), "c_shoulders": _middle(F.col("left_shoulder"), F.col("right_shoulder")), "c_hips": _middle(F.col("left_hip"), F.col("right_hip")),
        "c_lead_wrist": F.col("lead_wrist"), "c_trail_wrist": F.col("trail_wrist"), "c_hands": _middle(F.col("lead_wrist"), F.col("trail_wrist"))})
    torso = _length(F.col("c_shoulders"), F.col("c_hips"))
    return out.withColumn("torso", F.when(torso >= LEAST_PX, torso))


def body_references(first: DataFrame) -> DataFrame:
    """From each recording's frame of the first position (as ``named`` gives it): scale (torso length), sign (of the image's x toward the target or the ball, null with a reason), the centres, and why there is no reference."""
    face = F.col("view") == "face_on"
    cue = F.when(face, F.col("lead_hip.x") - F.col("trail_hip.x")).otherwise(F.col("c_shoulders.x") - F.col("c_hips.x"))
    why = F.when(face & (F.col("lead_hip").isNull() | F.col("trail_hip").isNull()), "P1 hips not detected").when(F.abs(cue) < LEAST_CUE * F.col("torso"), F.when(face, "P1 hips overlap horizontally; target direction unknown").otherwise("no forward bend at P1; ball direction unknown"))
    none = F.when(F.col("torso").isNull(), "P1 torso (both shoulders and both hips) not detected")
    sign = F.when(none.isNull() & why.isNull(), F.when(cue > 0, 1.0).otherwise(-1.0))
    return first.select("video_id", F.col("torso").alias("scale"), sign.alias("sign"), F.when(none.isNull(), why).alias("orientation_reason"), none.alias("no_reference"), *[F.col(f"c_{c}").alias(f"p1_{c}") for c in CENTRES])


def measurements(points: DataFrame, references: DataFrame) -> DataFrame:
    """video_id, frame, key, value, reason: four flexions, spine, shoulder tilt and lead arm in degrees, and each centre's displacement from the first position in torso lengths (toward target or ball, and up).  A reason stands where there is no value."""
    p = points.join(references, "video_id", "left")
    c, rows = F.col, []

    def emit(key: str, value: Column, reason: Column) -> None:
        rows.append(F.struct(F.lit(key).alias("key"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason")))

    gone = lambda *names: F.when(F.greatest(*[c(n).isNull().cast("int") for n in (names if len(names) > 1 else names * 2)]) == 1, "landmark not detected")
    for side in ("lead", "trail"):
        for key, joints in (("elbow", ("shoulder", "elbow", "wrist")), ("knee", ("hip", "knee", "ankle"))):
            a, v, b = (f"{side}_{j}" for j in joints)
            u, w = _length(c(a), c(v)), _length(c(b), c(v))
            cos = ((c(f"{a}.x") - c(f"{v}.x")) * (c(f"{b}.x") - c(f"{v}.x")) + (c(f"{a}.y") - c(f"{v}.y")) * (c(f"{b}.y") - c(f"{v}.y"))) / (u * w)
            emit(f"{side}_{key}_flexion", 180 - F.degrees(F.acos(P.clipped(cos, -1.0, 1.0))), F.coalesce(gone(a, v, b), F.when((u < LEAST_PX) | (w < LEAST_PX), "zero-length segment")))
    oriented = F.when(c("sign").isNull(), F.coalesce("orientation_reason", "no_reference", F.lit("no P1 reference")))
    dx, dy = c("c_shoulders.x") - c("c_hips.x"), c("c_shoulders.y") - c("c_hips.y")
    emit("spine_inclination", F.degrees(F.atan2(c("sign") * dx, -dy)), F.coalesce(gone("c_shoulders", "c_hips"), oriented, F.when(F.hypot(dx, dy) < LEAST_PX, "zero-length segment")))
    narrow = _length(c("lead_shoulder"), c("trail_shoulder")) < LEAST_SHOULDERS * c("torso")
    flat = lambda a, b: F.when(_length(c(a), c(b)) < LEAST_PX, "zero-length segment")
    emit("shoulder_tilt", P.elevation(c("trail_shoulder"), c("lead_shoulder")), F.coalesce(gone("lead_shoulder", "trail_shoulder"), F.when(narrow, "shoulders overlap in this projection"), flat("trail_shoulder", "lead_shoulder")))
    emit("lead_arm_inclination", P.elevation(c("lead_shoulder"), c("lead_wrist")), F.coalesce(gone("lead_shoulder", "lead_wrist"), flat("lead_shoulder", "lead_wrist")))
    base = F.when(c("scale").isNull(), F.coalesce("no_reference", F.lit("no P1 reference")))
    for name in CENTRES:
        lost = F.coalesce(base, F.when(c(f"c_{name}").isNull(), "landmark not detected").when(c(f"p1_{name}").isNull(), "not detected at P1"))
        emit(f"{name}_dx", c("sign") * (c(f"c_{name}.x") - c(f"p1_{name}.x")) / c("scale"), F.coalesce(lost, oriented))
        emit(f"{name}_dy", (c(f"p1_{name}.y") - c(f"c_{name}.y")) / c("scale"), lost)
    return p.select("video_id", "frame", F.explode(F.array(*rows)).alias("m")).select("video_id", "frame", "m.*")


def slot_comparison(user: DataFrame, reference: DataFrame) -> DataFrame:
    """Measurements of a position (pair_id, key, value, reason) of two recordings of one view side by side: both values, user less reference, and a note of what is missing where."""
    side = lambda df, k: df.select("pair_id", "key", F.col("value").alias(f"{k}_value"), F.col("reason").alias(f"{k}_reason"))
    j = side(user, "user").join(side(reference, "ref"), ["pair_id", "key"])
    note = F.concat_ws("; ", F.concat(F.lit("user: "), "user_reason"), F.concat(F.lit("reference: "), "ref_reason"))
    return j.select("pair_id", "key", "user_value", "ref_value", (F.col("user_value") - F.col("ref_value")).alias("difference"), F.when(note != "", note).alias("note"))
