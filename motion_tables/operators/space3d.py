"""Gates and states of reconstructed points: speed bounds, timing, frame status, trust, and lines on the ground.  Every reason is a text in an array; no reasons means it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.catalog import reasons

# Bounds of the speed of landmarks in a full swing, metres a second, by class, and the points of each class; others have the ball's.
SPEEDS = {"clubhead": 70.0, "ball": 105.0, "hands_grip": 20.0, "forearm_elbow": 15.0, "head_torso": 6.0, "legs_feet": 6.0, "ground_marker": 1.0}
CLASSES = {
    "clubhead": "clubhead_center clubhead_heel clubhead_toe clubface_center shaft_hosel".split(),
    "ball": "ball_center".split(),
    "hands_grip": "left_wrist right_wrist left_thumb right_thumb left_index right_index left_pinky right_pinky left_hand_back right_hand_back shaft_butt".split(),
    "forearm_elbow": "left_elbow right_elbow left_forearm_marker right_forearm_marker".split(),
    "head_torso": "nose left_ear right_ear left_shoulder right_shoulder left_hip right_hip".split(),
    "legs_feet": "left_knee right_knee left_ankle right_ankle left_heel right_heel left_big_toe right_big_toe left_little_toe right_little_toe left_shoe_heel_contact right_shoe_heel_contact left_shoe_toe_contact right_shoe_toe_contact".split(),
    "ground_marker": "floor_a floor_b floor_c target_line_back target_line_front".split(),
}
#: A line on the ground shorter than this has no direction.
LEAST_M = 0.02


def speed_class(point: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for name, points in CLASSES.items():
        out = out.when(point.isin(points), name)
    return out.otherwise("ball")


def speed_bound(point: Column) -> Column:
    """Metres a second that a point is never faster than; of an unknown point the ball's."""
    kind, out = speed_class(point), F.when(F.lit(False), F.lit(None))
    for name, bound in SPEEDS.items():
        out = out.when(kind == name, bound)
    return out


def exposure_ms(alignment: Column, bounded: Column) -> Column:
    """What the exposures add to the timing error: nothing if it is in the uncertainty, the bound if there is one, null if unknown."""
    return F.when(alignment == "included", 0.0).when((alignment == "bounded") & bounded.isNotNull(), bounded)


def frame_timing(frames: DataFrame) -> DataFrame:
    """frames (pair_gap_ms, sync_uncertainty_ms, exposure_alignment, exposure_uncertainty_ms, scales array) with unknown (why there is no bound) and bound_ms, how far apart in real time the views of a frame may be."""
    exposure = exposure_ms(F.col("exposure_alignment"), F.col("exposure_uncertainty_ms"))
    known = F.filter("scales", lambda s: s.isNotNull())
    high, low = F.array_max(known), F.array_min(known)
    unknown = reasons(
        (F.col("sync_uncertainty_ms").isNull(), "synchronization uncertainty is unknown"), (exposure.isNull(), "exposure alignment is unknown"), (F.size(known) < F.size("scales"), "motion time of a stream is unknown"),
        ((F.size(known) == F.size("scales")) & (high - low > 1e-9 * high), "clocks run at different rates"),
    )
    out = frames.withColumn("unknown", unknown)
    bound = F.round(low * (F.col("pair_gap_ms") + F.col("sync_uncertainty_ms")) + exposure, 6)
    return out.withColumn("bound_ms", F.when(F.size("unknown") == 0, bound))


def point_timing(points: DataFrame, most_m: float) -> DataFrame:
    """points (point, bound_ms, placed) with timing_error_m, how far the point may have moved within the bound, and timing_status: not_applicable, unknown, within or exceeds."""
    error = F.when(F.col("placed") & F.col("bound_ms").isNotNull(), speed_bound(F.col("point")) * F.col("bound_ms") / 1000)
    out = points.withColumn("timing_error_m", error)
    return out.withColumn("timing_status", F.when(~F.col("placed"), "not_applicable").when(F.col("bound_ms").isNull(), "unknown").when(F.col("timing_error_m") <= most_m, "within").otherwise("exceeds"))


def frame_status(frames: DataFrame) -> DataFrame:
    """frames with reasons and status: measured if nothing stands against it, else unverified.

    Columns: kind (static_address or dynamic), calibration, shot_calibration, same_swing, synchronization (statuses), same_method, same_by, same_at, sync_offset_ms,
    sync_uncertainty_ms, estimated_views (frames with an estimated time), unverified_streams, unknown (of frame_timing).
    """
    dynamic = F.col("kind") == "dynamic"
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    own = F.concat(
        reasons(
            (F.col("calibration") != "verified", "calibration not verified"), (F.col("shot_calibration") != "verified", "the shot's calibration not verified"), (F.col("same_swing") != "verified", "same swing not verified"),
            ((F.col("same_swing") == "verified") & (blank("same_method") | blank("same_by") | blank("same_at")), "same swing verified without provenance"),
            (dynamic & (F.col("synchronization") != "verified"), "synchronization not verified"),
            (dynamic & (F.col("synchronization") == "verified") & (F.col("sync_offset_ms").isNull() | F.col("sync_uncertainty_ms").isNull()), "synchronization without offset or uncertainty"),
            (dynamic & (F.col("estimated_views") > 0), "estimated timestamp"), (dynamic & (F.col("unverified_streams") > 0), "source timestamps not verified"),
        ),
        F.when(dynamic, F.transform("unknown", lambda u: F.concat(F.lit("timing bound unknown: "), u))).otherwise(F.array().cast("array<string>")),
    )
    out = frames.withColumn("reasons", own)
    return out.withColumn("status", F.when(F.size("reasons") == 0, "measured").otherwise("unverified"))


def point_states(views: DataFrame) -> DataFrame:
    """From every view's label of a point (shot_id, frame, point, visible, origin, reviewed, problem: why the triangulated point is not valid, null if it is): views, state, reason.

    A point of one view is missing, so is one with a problem; one that some view did not see, or has from a model without review, is inferred.
    """
    guessed = ~F.col("visible") | ((F.col("origin") == "model_proposed") & ~F.coalesce(F.col("reviewed"), F.lit(False)))
    g = views.groupBy("shot_id", "frame", "point").agg(F.count("*").alias("views"), F.max(guessed.cast("int")).alias("guessed"), F.max("problem").alias("problem"))
    state = F.when((F.col("views") < 2) | F.col("problem").isNotNull(), "missing").when(F.col("guessed") == 1, "inferred").otherwise("observed")
    return g.select("shot_id", "frame", "point", "views", state.alias("state"), F.when(F.col("views") < 2, "seen in one view only").otherwise(F.col("problem")).alias("reason"))


def trusted(points: DataFrame, allow_inferred: bool = False) -> DataFrame:
    """points (kind, frame_status, state, timing_status) with problem: why one is no measured input, null if it is."""
    fine = ["observed", "inferred"] if allow_inferred else ["observed"]
    late = F.when(F.col("timing_status") == "unknown", "timing bound unknown").when(F.col("timing_status") != "within", "may move too far between the exposures")
    return points.withColumn("problem", F.when(F.col("frame_status") != "measured", "frame not measured").when(~F.col("state").isin(fine), F.concat(F.lit("point is "), F.col("state"))).when(F.col("kind") == "dynamic", late))


def state_summary(points: DataFrame) -> DataFrame:
    """By shot: points by state, those missing in all views apart (not_labelled), timing statuses, the largest bound and reprojection of placed points."""
    n = lambda c: F.sum(c.cast("long"))
    missing, unlabelled = F.col("state") == "missing", F.col("views") == 0
    return points.groupBy("shot_id").agg(
        n(F.col("state") == "observed").alias("observed"), n(F.col("state") == "inferred").alias("inferred"), n(missing & ~unlabelled).alias("missing"), n(missing & unlabelled).alias("not_labelled"),
        *[n(F.col("timing_status") == s).alias(f"timing_{s}") for s in ("within", "exceeds", "unknown")], F.max("bound_ms").alias("max_bound_ms"), F.max(F.when(~missing, F.col("reprojection_px"))).alias("max_reprojection_px"),
    )


def timestamp_status(frames: DataFrame, tolerance_ms: float) -> DataFrame:
    """By recording, from decoded times and those of an independent probe (t_ms, probed_ms, estimated): status, start_offset_ms, max_deviation_ms, estimated (frames).

    A frame without a probed time makes it unverified, a difference over the tolerance inconsistent, an estimated time estimated; else it is verified.
    """
    first = F.min_by("probed_ms", "frame")
    g = frames.groupBy("video_id").agg(F.sum(F.col("probed_ms").isNull().cast("long")).alias("gone"), first.alias("start"), F.sum(F.col("estimated").cast("long")).alias("estimated"))
    far = frames.join(g, "video_id").groupBy("video_id", "gone", "start", g["estimated"]).agg(F.max(F.abs(F.col("probed_ms") - F.col("start") - F.col("t_ms"))).alias("far"))
    whole = F.col("gone") == 0
    deviation = F.when(whole, F.round("far", 3))
    status = F.when(F.col("estimated") > 0, "estimated").when(~whole, "unverified").when(deviation > tolerance_ms, "inconsistent").otherwise("verified")
    return far.select("video_id", status.alias("status"), F.when(whole, F.round("start", 3)).alias("start_offset_ms"), deviation.alias("max_deviation_ms"), "estimated")


def moved(points: DataFrame, transform: Column) -> DataFrame:
    """points (x, y, z and cov, nine numbers) under a rigid transform of 16 numbers, row by row."""
    t = lambda i, j: F.get(transform, F.lit(4 * i + j))
    place = [t(i, 0) * F.col("x") + t(i, 1) * F.col("y") + t(i, 2) * F.col("z") + t(i, 3) for i in range(3)]
    c = lambda i, j: F.get("cov", F.lit(3 * i + j))
    half = lambda i, j: sum((t(i, k) * c(k, j) for k in range(1, 3)), t(i, 0) * c(0, j))
    cov = F.array(*[half(i, 0) * t(j, 0) + half(i, 1) * t(j, 1) + half(i, 2) * t(j, 2) for i in range(3) for j in range(3)])
    return points.withColumns({"x": place[0], "y": place[1], "z": place[2], "cov": cov})


def inverted(transform: Column) -> Column:
    """The inverse of a rigid transform of 16 numbers."""
    t = lambda i, j: F.get(transform, F.lit(4 * i + j))
    rows = [[t(0, i), t(1, i), t(2, i), -(t(0, i) * t(0, 3) + t(1, i) * t(1, 3) + t(2, i) * t(2, 3))] for i in range(3)]
    return F.array(*[c for r in rows for c in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def ground_lines(ends: DataFrame) -> DataFrame:
    """Lines from trail to lead side (shot_id, line, handedness, ax, ay, bx, by, their variances vax, vay, vbx, vby) on the ground: yaw_deg, open_deg (positive: open), sigma_deg; null with a reason if too short for a direction."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    var = (dy * dy * (F.col("vax") + F.col("vbx")) + dx * dx * (F.col("vay") + F.col("vby"))) / (square * square)
    ok = F.sqrt(square) >= LEAST_M
    yaw = F.degrees(F.atan2(dy, dx))
    sign = F.when(F.col("handedness") == "right", 1.0).otherwise(-1.0)
    return ends.select("shot_id", "line", F.when(ok, yaw).alias("yaw_deg"), F.when(ok, sign * yaw).alias("open_deg"), F.when(ok, F.degrees(F.sqrt(var))).alias("sigma_deg"), F.when(~ok, "too short on the ground").alias("reason"))


def line_differences(lines: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """shot_id, key, value, sigma_deg of one line's opening less another's, for pairs of lines of one shot."""
    wanted = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    side = lambda k: lines.select("shot_id", F.col("line").alias(k), F.col("open_deg").alias(f"{k}_open"), F.col("sigma_deg").alias(f"{k}_sigma"))
    each = lines.select("shot_id").distinct().select("shot_id", F.explode(wanted).alias("w")).select("shot_id", "w.*")
    j = each.join(side("a"), ["shot_id", "a"]).join(side("b"), ["shot_id", "b"])
    return j.select("shot_id", F.concat("a", F.lit("_minus_"), "b").alias("key"), (F.col("a_open") - F.col("b_open")).alias("value"), F.hypot("a_sigma", "b_sigma").alias("sigma_deg"))


def foot_flare(feet: DataFrame) -> DataFrame:
    """Heels and toes (shot_id, role lead or trail, handedness, hx, hy, tx, ty): flare_deg, how far the toe is turned out from square to the target line."""
    dx, dy = F.col("tx") - F.col("hx"), F.col("ty") - F.col("hy")
    sign = F.when(F.col("handedness") == "right", 1.0).otherwise(-1.0)
    out = F.when(F.col("role") == "lead", 1.0).otherwise(-1.0)
    flare = sign * out * P.wrap_degrees(F.degrees(F.atan2(dy, dx)) + 90.0 * sign)
    return feet.select("shot_id", "role", F.when(F.hypot(dx, dy) >= LEAST_M, flare).alias("flare_deg"))


def tracking_centres(parts: DataFrame) -> DataFrame:
    """Of every frame's club parts (shot_id, frame, part, x, y, z, placed points alone): the clubhead's centre, or else the middle of heel and toe, never a point of the shaft; with its basis.  And the shaft's length from grip end to hosel."""
    at = lambda part: F.max(F.when(F.col("part") == part, F.struct("x", "y", "z")))
    g = parts.groupBy("shot_id", "frame").agg(*[at(p).alias(p) for p in ("clubhead_center", "clubhead_heel", "clubhead_toe", "shaft_butt", "shaft_hosel")])
    both = F.col("clubhead_heel").isNotNull() & F.col("clubhead_toe").isNotNull()
    own = F.col("clubhead_center").isNotNull()
    axis = lambda k: F.when(own, F.col(f"clubhead_center.{k}")).when(both, (F.col(f"clubhead_heel.{k}") + F.col(f"clubhead_toe.{k}")) / 2).alias(k)
    d = [F.col(f"shaft_hosel.{k}") - F.col(f"shaft_butt.{k}") for k in "xyz"]
    return g.select("shot_id", "frame", *[axis(k) for k in "xyz"], F.when(own, "clubhead_center").when(both, "heel-toe midpoint").alias("basis"), F.sqrt(P.dot(d, d)).alias("shaft_length_m"))
