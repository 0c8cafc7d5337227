"""Fits to a shot's points in space: the clubhead's velocity at impact, the swing's plane, the free arc's low point, and the world's frame.

Every fit follows from moments: sums of powers of time, covariances, and the eigenvalues of a covariance in closed form.  They are aggregations and windows over one partitioning by shot; no
samples are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.catalog import reasons
from motion_tables.operators.geometry import point_reasons, triangulated

# Limits of a fit.
MAX_GAP, MAX_PLANE_RMS_M, MIN_INCLINATION_DEG, MAX_GROUND_RMS_M, MIN_BASELINE_M = 1.6, 0.05, 15.0, 0.02, 0.3
MAX_RISE_DEG, LEVEL = 60.0, 1e-6


def usable_samples(samples: DataFrame, max_sigma_m: float) -> DataFrame:
    """samples (status, x null if not observed, rigid, sigma_m, problem: why a point is not trusted) with dropped: why one is no sample, null if it is."""
    why = F.when(F.col("status") != "measured", "frame not measured").when(F.col("x").isNull(), "tracking centre not observed").when(~F.col("rigid"), "inconsistent club geometry").when(F.col("sigma_m") > max_sigma_m, "tracking centre uncertain").otherwise(F.col("problem"))
    return samples.withColumn("dropped", why)


def largest_sigma(df: DataFrame) -> DataFrame:
    """df (cov, nine numbers) with sigma_m, the square root of the largest variance in any direction: the largest eigenvalue of a symmetric matrix, in closed form."""
    c = {k: F.get("cov", F.lit(3 * i + j)) for k, i, j in (("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2))}
    return df.withColumn("sigma_m", F.sqrt(F.greatest(_eigenvalues(c)[0], F.lit(0.0))))


Vector = tuple[Column, Column, Column]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _eigenvalues(c: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Of a symmetric matrix (xx, xy, ...), largest first, in closed form."""
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    dx, dy, dz = c["xx"] - q, c["yy"] - q, c["zz"] - q
    p = F.sqrt((dx**2 + dy**2 + dz**2 + 2 * (c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2)) / 6)
    det = dx * (dy * dz - c["yz"] ** 2) - c["xy"] * (c["xy"] * dz - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - dy * c["xz"])
    turn = F.acos(P.clipped(F.coalesce(det / F.when(p > 0, 2 * p**3), F.lit(1.0)), -1.0, 1.0)) / 3
    third = 2.0943951023931953
    return q + 2 * p * F.cos(turn), q + 2 * p * F.cos(turn - third), q + 2 * p * F.cos(turn + third)


def _with_normal(df: DataFrame, c: dict[str, Column]) -> DataFrame:
    """df with _n (the unit normal of the plane through the mean that is nearest to points of this covariance), _off (the root of their mean squared distance from it) and _second (their variance along the plane's short side).

    The normal is at right angles to the rows of the covariance less its smallest eigenvalue; the longest of the three products of two rows is the best known.
    """
    l1, l2, l3 = _eigenvalues(c)
    df = df.withColumn("_l", l3)
    x, y, z = (c["xx"] - F.col("_l"), c["xy"], c["xz"]), (c["xy"], c["yy"] - F.col("_l"), c["yz"]), (c["xz"], c["yz"], c["zz"] - F.col("_l"))
    products = [F.struct(_dot(v, v).alias("size"), *[e.alias(k) for e, k in zip(v, "xyz")]) for v in (_cross(x, y), _cross(y, z), _cross(z, x))]
    df = df.withColumn("_v", F.greatest(*products)).withColumn("_n", F.struct(*[(F.col(f"_v.{k}") / F.sqrt("_v.size")).alias(k) for k in "xyz"]))
    n = _parts("_n")
    across = c["xx"] * n[0] ** 2 + c["yy"] * n[1] ** 2 + c["zz"] * n[2] ** 2 + 2 * (c["xy"] * n[0] * n[1] + c["xz"] * n[0] * n[2] + c["yz"] * n[1] * n[2])
    return df.withColumn("_off", F.sqrt(F.greatest(across, F.lit(0.0)))).withColumn("_second", l2).drop("_l", "_v")


def _parts(name: str) -> Vector:
    return F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z")


_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _covariance(over=None) -> dict[str, Column]:
    return {k: F.covar_pop(k[0], k[1]) if over is None else F.covar_pop(k[0], k[1]).over(over) for k in _PAIRS}


def impact_velocity(samples: DataFrame, window_s: float = 0.010) -> DataFrame:
    """From usable samples (shot_id, t in seconds from impact, x, y, z, sigma_m, timing_error_m): speed, path_yaw_deg, attack_deg, speed_sigma, angle_sigma_deg, timing_bound (of the velocity, worst case) and reason.

    The velocity is the slope at impact of the quadratic nearest to the samples within the window, a weighted sum of them; weights follow from the sums of powers of time. Two samples
    are needed on either side, and no gap of over 1.6 median steps.
    """
    shot = Window.partitionBy("shot_id")
    s = samples.where(F.col("t").between(-window_s, window_s)).withColumn("_t", F.col("t") / window_s).withColumn("_step", F.col("t") - F.lag("t").over(shot.orderBy("t")))
    s = s.withColumns({f"_{k}": F.sum(F.col("_t") ** k if k else F.lit(1.0)).over(shot) for k in range(5)})
    m = [F.col(f"_{k}") for k in range(5)]
    det = m[0] * (m[2] * m[4] - m[3] ** 2) - m[1] * (m[1] * m[4] - m[2] * m[3]) + m[2] * (m[1] * m[3] - m[2] ** 2)
    weight = ((m[2] * m[3] - m[1] * m[4]) + (m[0] * m[4] - m[2] ** 2) * F.col("_t") + (m[1] * m[2] - m[0] * m[3]) * F.col("_t") ** 2) / F.when(det != 0, det) / window_s
    s = s.withColumn("_w", weight)
    g = s.groupBy("shot_id").agg(
        *[F.sum(F.col("_w") * F.col(k)).alias(f"v{k}") for k in "xyz"], (F.max("sigma_m") * F.sqrt(F.sum(F.col("_w") ** 2))).alias("sigma"), F.sum(F.abs("_w") * F.col("timing_error_m")).alias("bound"),
        F.least(F.count_if(F.col("t") < 0), F.count_if(F.col("t") > 0)).alias("side"), F.max("_step").alias("longest"), F.median("_step").alias("usual"),
    )
    reason = F.when(F.col("side") < 2, "needs two usable samples on each side of impact").when(F.col("longest") > MAX_GAP * F.col("usual"), "a gap in the samples around impact")
    flat = F.hypot("vx", "vy")
    g = g.withColumn("reason", reason).withColumn("speed", F.hypot(flat, F.col("vz")))
    values = {"speed": F.col("speed"), "path_yaw_deg": F.degrees(F.atan2("vy", "vx")), "attack_deg": F.degrees(F.atan2(F.col("vz"), flat)), "speed_sigma": F.col("sigma"), "angle_sigma_deg": F.degrees(F.col("sigma") / F.col("speed")), "timing_bound": F.col("bound")}
    return g.select("shot_id", *[F.when(F.col("reason").isNull(), v).alias(k) for k, v in values.items()], "reason")


def swing_planes(samples: DataFrame, window_s: float = 0.060) -> DataFrame:
    """direction_deg (of the plane's level line toward the target), inclination_deg, rms_m and reason of the plane through seven or more samples around impact."""
    s = samples.where(F.col("t").between(-window_s, window_s)).groupBy("shot_id")
    g = s.agg(F.count("*").alias("n"), F.least(F.count_if(F.col("t") < 0), F.count_if(F.col("t") > 0)).alias("side"), *[c.alias(f"c{k}") for k, c in _covariance().items()])
    g = _with_normal(g, {k: F.col(f"c{k}") for k in _PAIRS})
    nx, ny, nz = _parts("_n")
    tilt = F.degrees(F.acos(F.least(F.abs(nz), F.lit(1.0))))
    toward = F.when(ny < 0, -1.0).otherwise(1.0)  # the level line is at right angles to the normal, and points to greater x
    reason = F.when((F.col("n") < 7) | (F.col("side") < 2), "needs seven usable samples that span impact").when(F.col("_off") > MAX_PLANE_RMS_M, "samples are off a plane").when(tilt < MIN_INCLINATION_DEG, "plane nearly level")
    g = g.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    return g.select("shot_id", F.when(fine, F.degrees(F.atan2(-toward * nx, toward * ny))).alias("direction_deg"), F.when(fine, tilt).alias("inclination_deg"), F.when(~F.coalesce(F.col("reason").startswith("needs"), F.lit(False)), F.col("_off")).alias("rms_m"), "reason")


def arc_low_points(samples: DataFrame, low_s: float = -0.060, high_s: float = -0.002, least: int = 5) -> DataFrame:
    """x, y, z, radius_m, rms_m and reason of the lowest point of the circle through a shot's samples before impact: an extrapolation.

    Samples are measured in their plane, along its steepest way down (a) and across it (b), from their mean.  There the circle's centre solves two equations in the
    covariances of a, b and a^2 + b^2, and its lowest point lies a radius further along a.
    """
    shot = Window.partitionBy("shot_id")
    s = samples.where(F.col("t").between(low_s, high_s)).select("shot_id", "x", "y", "z")
    s = s.withColumns({f"c{k}": c for k, c in _covariance(shot).items()} | {f"m{k}": F.avg(k).over(shot) for k in "xyz"} | {"n": F.count("*").over(shot)})
    s = _with_normal(s, {k: F.col(f"c{k}") for k in _PAIRS})
    nx, ny, nz = _parts("_n")
    steep = F.sqrt(F.greatest(1 - nz**2, F.lit(0.0)))
    level = steep < LEVEL
    other = F.sqrt(F.greatest(1 - nx**2, F.lit(1e-12)))  # where nothing leads down, along x
    down = [F.when(level, v / other).otherwise(w / steep) for v, w in ((1 - nx**2, nx * nz), (-nx * ny, ny * nz), (-nx * nz, nz**2 - 1))]
    s = s.withColumn("_level", level).withColumn("_e", F.struct(*[v.alias(k) for v, k in zip(down, "xyz")]))
    e = _parts("_e")
    s = s.withColumn("_f", F.struct(*[v.alias(k) for v, k in zip(_cross((nx, ny, nz), e), "xyz")]))
    from_mean = tuple(F.col(k) - F.col(f"m{k}") for k in "xyz")
    s = s.withColumn("_a", _dot(e, from_mean)).withColumn("_b", _dot(_parts("_f"), from_mean)).withColumn("_q", F.col("_a") ** 2 + F.col("_b") ** 2)
    cov = {k: F.covar_pop(f"_{k[0]}", f"_{k[1]}").over(shot) for k in ("aa", "ab", "bb", "aq", "bq")}
    s = s.withColumns({f"_{k}": c for k, c in cov.items()} | {"_size": F.avg("_q").over(shot)})
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") ** 2
    det = F.when(det > 0, 2 * det)
    s = s.withColumn("_ka", (F.col("_bb") * F.col("_aq") - F.col("_ab") * F.col("_bq")) / det).withColumn("_kb", (F.col("_aa") * F.col("_bq") - F.col("_ab") * F.col("_aq")) / det)
    s = s.withColumn("_r", F.sqrt(F.col("_size") + F.col("_ka") ** 2 + F.col("_kb") ** 2))
    s = s.withColumn("_d", (F.hypot(F.col("_a") - F.col("_ka"), F.col("_b") - F.col("_kb")) - F.col("_r")) ** 2)
    same = ["n", "mx", "my", "mz", "_e", "_f", "_level", "_off", "_ka", "_kb", "_r"]
    g = s.groupBy("shot_id").agg(*[F.first(c).alias(c) for c in same], F.sqrt(F.avg("_d")).alias("_round"))
    reason = F.when(F.col("n") < least, "too few samples before impact").when(F.col("_r").isNull(), "samples in one line").when(F.col("_level"), "plane level")
    few = F.col("n") < least
    place = [F.when(F.col("reason").isNull(), F.col(f"m{k}") + (F.col("_ka") + F.col("_r")) * F.col(f"_e.{k}") + F.col("_kb") * F.col(f"_f.{k}")).alias(k) for k in "xyz"]
    return g.withColumn("reason", reason).select("shot_id", *place, F.when(~few, F.col("_r")).alias("radius_m"), F.when(~few, F.greatest("_off", "_round")).alias("rms_m"), "reason")


def world_frames(evidence: DataFrame) -> DataFrame:
    """rig_to_world (16 numbers) and reason of each shot (shot_id, ground: array of points of three numbers, back, front: of the target line, ball, up: a point above the ground).

    The ground is the plane of its points, x along the target line, the origin under the ball; without one of them the frame is undefined.
    """
    def mean(f) -> Column:
        return F.aggregate(F.transform("ground", f), F.lit(0.0), lambda a, v: a + v) / F.size("ground")

    def vector(name: str) -> Vector:
        return tuple(F.get(name, F.lit(i)).cast("double") for i in range(3))

    def at(k: str):
        return lambda p: F.get(p, F.lit("xyz".index(k))).cast("double")

    def product(k: str, l: str):
        return lambda p: (at(k)(p) - F.col(f"m{k}")) * (at(l)(p) - F.col(f"m{l}"))

    s = evidence.withColumns({f"m{k}": mean(at(k)) for k in "xyz"})
    s = s.withColumns({f"c{k}": mean(product(*k)) for k in _PAIRS})
    s = _with_normal(s, {k: F.col(f"c{k}") for k in _PAIRS})
    n, middle = _parts("_n"), (F.col("mx"), F.col("my"), F.col("mz"))
    above = _dot(n, tuple(u - m for u, m in zip(vector("up"), middle))) < 0
    s = s.withColumn("_n", F.when(above, F.struct(*[(-v).alias(k) for v, k in zip(n, "xyz")])).otherwise(F.col("_n")))
    line = tuple(a - b for a, b in zip(vector("front"), vector("back")))
    s = s.withColumn("_line", F.struct(*[v.alias(k) for v, k in zip(line, "xyz")])).withColumn("_length", F.sqrt(_dot(line, line))).withColumn("_rise", _dot(_parts("_line"), n))
    reason = (
        F.when(F.col("ball").isNull(), "no ball").when(F.coalesce(F.col("_length") < MIN_BASELINE_M, F.lit(True)), "no target line").when(F.coalesce(F.size("ground"), F.lit(0)) < 3, "no ground")
        .when(F.col("_second") * F.size("ground") < 1e-12, "ground points in one line").when(F.col("_off") > MAX_GROUND_RMS_M, "ground points off a plane").when(F.degrees(F.asin(F.least(F.abs(F.col("_rise")) / F.col("_length"), F.lit(1.0)))) > MAX_RISE_DEG, "target line nearly upright")
    )
    s = s.withColumn("reason", reason)
    run = F.sqrt(F.col("_length") ** 2 - F.col("_rise") ** 2)
    x = tuple((v - F.col("_rise") * w) / run for v, w in zip(_parts("_line"), n))
    s = s.withColumn("_x", F.struct(*[v.alias(k) for v, k in zip(x, "xyz")]))
    rows = [_parts("_x"), _cross(n, _parts("_x")), n]
    ball = vector("ball")
    # the origin is the ball's foot: along the ground as far as the ball, and in the ground upwards
    foot = [_dot(rows[0], ball), _dot(rows[1], ball), _dot(n, middle)]
    matrix = F.array(*[v for r, a in zip(rows, foot) for v in (*r, -a)], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return s.select("shot_id", F.when(F.col("reason").isNull(), matrix).alias("rig_to_world"), "reason")


def known_distances(ends: DataFrame, cameras: DataFrame, pairs: DataFrame, tolerance_m: float, max_sigma_m: float) -> DataFrame:
    """Of marks a known distance apart, seen by a rig: measured_m, error_m, reasons (why an end is no measurement), within (the tolerance) and verified: within, and both ends valid.

    ``ends``: pair_id, end (0 or 1), camera_id, u, v; both are triangulated as any point is.  ``pairs``: pair_id, distance_m.  A length that happens to match from bad geometry verifies nothing; an end
    that one camera alone sees is no point, so the pair has no length.
    """
    seen = ends.select((F.col("pair_id") * 2 + F.col("end")).alias("point_id"), "camera_id", "u", "v")
    p = largest_sigma(point_reasons(triangulated(seen, cameras))).withColumn("reasons", F.concat("reasons", F.when(F.col("sigma_m") > max_sigma_m, F.array(F.lit("place uncertain"))).otherwise(F.array().cast("array<string>"))))
    side = lambda k: p.where(F.pmod("point_id", F.lit(2)) == k).select(F.floor(F.col("point_id") / 2).alias("pair_id"), F.struct("x", "y", "z").alias(f"_p{k}"), F.col("reasons").alias(f"_r{k}"))
    j = pairs.join(side(0), "pair_id", "left").join(side(1), "pair_id", "left")
    gap = tuple(F.col(f"_p0.{k}") - F.col(f"_p1.{k}") for k in "xyz")
    j = j.withColumn("measured_m", F.sqrt(_dot(gap, gap))).withColumn("error_m", F.col("measured_m") - F.col("distance_m")).withColumn("within", F.coalesce(F.abs("error_m") <= tolerance_m, F.lit(False)))
    reasons_ = F.when(F.col("measured_m").isNull(), F.array(F.lit("an end without two views"))).otherwise(F.array_sort(F.array_distinct(F.concat("_r0", "_r1"))))
    j = j.withColumn("reasons", reasons_)
    return j.select("pair_id", "distance_m", "measured_m", "error_m", "within", "reasons", (F.col("within") & (F.size("reasons") == 0)).alias("verified"))


def measurement_documents(values: DataFrame, impacts: DataFrame) -> DataFrame:
    """A JSON document for each shot: its impact's time and its values (shot_id, key, value, unit, sigma, reason) in order of key; a value without a number has its reason."""
    status = F.when(F.col("value").isNull(), "unavailable").otherwise("measured")
    v = F.struct("key", F.struct("value", "unit", "sigma", status.alias("status"), "reason").alias("v"))
    g = values.groupBy("shot_id").agg(F.array_sort(F.collect_list(v)).alias("s"))
    j = g.join(impacts, "shot_id", "left")
    return j.select("shot_id", F.to_json(F.struct(F.col("impact_ms"), F.map_from_arrays(F.col("s")["key"], F.col("s")["v"]).alias("values"))).alias("doc"))


def stereo_gate(shots: DataFrame, streams: DataFrame) -> DataFrame:
    """shot_id, reasons why a shot's streams (shot_id, stream_id, calibrated, the calibration's and the source's width and height, labelled_sha, sha) cannot be triangulated; none if they can."""
    s = streams.select("shot_id", F.explode(reasons(
        (~F.col("calibrated"), "a stream without calibration"), (F.col("calibrated") & ((F.col("cal_width") != F.col("width")) | (F.col("cal_height") != F.col("height"))), "calibrated at another size"),
        (F.col("labelled_sha").isNull(), "a stream without labels"), (F.col("labelled_sha") != F.col("sha"), "labelled on other bytes"),
    )).alias("why"))
    own = s.groupBy("shot_id").agg(F.array_sort(F.collect_set("why")).alias("of_streams"))
    n = streams.groupBy("shot_id").agg(F.count("*").alias("n"))
    j = shots.join(n, "shot_id", "left").join(own, "shot_id", "left")
    top = reasons((F.coalesce("n", F.lit(0)) < 2, "one view"), (~F.col("same_status").isin("asserted", "verified") | F.col("same_method").isNull(), "same swing not documented"))
    return j.select("shot_id", F.concat(top, F.coalesce("of_streams", F.array().cast("array<string>"))).alias("reasons"))
