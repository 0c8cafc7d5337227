"""Per-recording series: each function adds columns by windows over one partitioning, (key, frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions import pose as P

KEY = "video_id"


def by(key: str | list[str] = KEY, order: str = "frame"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def whole(key: str | list[str] = KEY):
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def wrist_speed(p: DataFrame) -> DataFrame:
    """speed: of the wrists' middle in the image, units a second; 0 for the first frame, no step shorter than 1 ms."""
    w = by()
    l, r = P.at(F.col("lm"), P.L_WRIST), P.at(F.col("lm"), P.R_WRIST)
    m = p.withColumn("mx", P.mid(l, r, "x")).withColumn("my", P.mid(l, r, "y"))
    dt = F.greatest(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(1.0)) / 1000
    step = F.hypot(F.col("mx") - F.lag("mx").over(w), F.col("my") - F.lag("my").over(w))
    return m.withColumn("speed", F.coalesce(step / dt, F.lit(0.0))).drop("mx", "my")


def carried_forward(p: DataFrame) -> DataFrame:
    """valid: false for a frame whose landmarks repeat the frame before it exactly."""
    return p.withColumn("valid", ~F.coalesce(F.col("lm") == F.lag("lm").over(by()), F.lit(False)))


def hand_speed(p: DataFrame) -> DataFrame:
    """hand_speed: of the wrists' middle in body scales a second; carried-forward frames, and those without a time step, keep the last speed; the first frame has the second's."""
    w = by()
    p = carried_forward(p)
    l, r = P.at(F.col("lm"), P.L_WRIST), P.at(F.col("lm"), P.R_WRIST)
    m = p.withColumn("mx", P.mid(l, r, "x")).withColumn("my", P.mid(l, r, "y")).withColumn("scale", P.body_scale(F.col("lm")))
    dt = (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000
    good = F.col("valid") & F.lag("valid").over(w) & (dt > 0)
    own = F.when(good, F.hypot(F.col("mx") - F.lag("mx").over(w), F.col("my") - F.lag("my").over(w)) / F.col("scale") / dt)
    m = m.withColumn("own", F.when(F.col("frame") == 0, 0.0).otherwise(own))
    m = m.withColumn("hand_speed", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("frame") == 0, F.coalesce(F.lead("hand_speed").over(w), F.col("hand_speed"))).otherwise(F.col("hand_speed"))
    return m.withColumn("hand_speed", first).drop("mx", "my", "own", "scale")


def moving_average(s: DataFrame, column: str, taps: int, into: str) -> DataFrame:
    """A moving average that counts values beyond either end as 0."""
    k = taps // 2
    return s.withColumn(into, F.sum(column).over(by().rowsBetween(-k, k)) / taps)


def spike_deviation(pts: DataFrame) -> DataFrame:
    """deviation: distance of a point from the middle of its neighbours in time; null unless all three are valid."""
    w = by([KEY, "backend", "joint"])
    ok = F.col("valid") & F.lag("valid").over(w) & F.lead("valid").over(w)
    d = F.hypot(F.col("x") - (F.lag("x").over(w) + F.lead("x").over(w)) / 2, F.col("y") - (F.lag("y").over(w) + F.lead("y").over(w)) / 2)
    return pts.withColumn("deviation", F.when(ok, d))


def swap_test(sides: DataFrame) -> DataFrame:
    """From lx, ly, rx, ry and ok of a left/right pair a frame: keep and swap, the motion if the labels are right or exchanged; null unless both frames are ok."""
    w = by([KEY, "backend", "part"])
    move = lambda a, b: F.hypot(F.col(a + "x") - F.lag(b + "x").over(w), F.col(a + "y") - F.lag(b + "y").over(w))
    both = F.col("ok") & F.lag("ok").over(w)
    return sides.withColumn("keep", F.when(both, move("l", "l") + move("r", "r"))).withColumn("swap", F.when(both, move("l", "r") + move("r", "l")))


def savgol7(s: DataFrame, column: str, into: str, key: str | list[str] = KEY) -> DataFrame:
    """Savitzky-Golay smoothing, window 7, order 2; the ends come from the fit of the first or last seven values; a series under seven stays."""
    w, all_ = by(key), whole(key)
    n = F.count("*").over(all_)
    place = F.row_number().over(w) - 1
    # Rows 0 to 3 of the projection of seven values on a quadratic, times 42 or 21.
    rows = [[32, 15, 3, -4, -6, -3, 5], [5, 4, 3, 2, 1, 0, -1], [1, 3, 4, 4, 3, 1, -2], [-2, 3, 6, 7, 6, 3, -2]]
    rows = [rows[0], [x * 3 for x in rows[1]], [x * 3 for x in rows[2]], [x * 2 for x in rows[3]]]
    near = [F.lag(column, 3 - k).over(w) if k < 3 else (F.col(column) if k == 3 else F.lead(column, k - 3).over(w)) for k in range(7)]
    fit = lambda weights, values: sum((v * c for v, c in zip(values, weights)), F.lit(0.0)) / 42
    head = [F.nth_value(column, k + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in range(7)]
    out = s.withColumn("_n", n).withColumn("_i", place)
    back = all_.orderBy(F.col("frame").desc())
    tail = [F.nth_value(column, k + 1).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in range(7)]
    expr = F.when(F.col("_n") < 7, F.col(column))
    for i in range(3):
        expr = expr.when(F.col("_i") == i, fit(rows[i], head)).when(F.col("_i") == F.col("_n") - 1 - i, fit(rows[i], tail))
    return out.withColumn(into, expr.otherwise(fit(rows[3], near))).drop("_n", "_i")


def wrist_velocity(p: DataFrame) -> DataFrame:
    """velocity: mean of the wrists' steps in space a second, no step under 1 ms; 0 for the first frame."""
    w = by()
    dt = F.greatest((F.col("t_ms") - F.lag("t_ms").over(w)) / 1000, F.lit(0.001))

    def moved(j: int) -> Column:
        q = P.at(F.col("lm"), j)
        d = [q[k] - F.lag(q[k]).over(w) for k in "xyz"]
        return F.sqrt(P.dot(d, d))

    return p.withColumn("velocity", F.coalesce((moved(P.L_WRIST) + moved(P.R_WRIST)) / 2 / dt, F.lit(0.0)))


def frame_deltas(s: DataFrame, time: str = "t_ms") -> DataFrame:
    """delta_ms: time since the frame before, within 0.1 and 100 ms; 0 for the first."""
    d = F.col(time) - F.lag(time).over(by())
    return s.withColumn("delta_ms", F.coalesce(P.clipped(d, 0.1, 100.0), F.lit(0.0)))


def crossings(s: DataFrame, column: str, valid: str | None = None) -> DataFrame:
    """Where a series changes sign: video_id, frame (the second of the two), t_ms of the crossing, nearest frame, slope a second."""
    w = by()
    v0, t0 = F.lag(column).over(w), F.lag("t_ms").over(w)
    ok = F.lit(True) if valid is None else F.col(valid) & F.lag(valid).over(w)
    two = s.select(KEY, "frame", F.col("t_ms").alias("t1"), F.col(column).alias("v1"), v0.alias("v0"), t0.alias("t0"), ok.alias("ok"))
    two = two.where(F.col("ok") & ((F.col("v0") > 0) != (F.col("v1") > 0)))
    part = F.col("v0") / (F.col("v0") - F.col("v1"))
    dt = (F.col("t1") - F.col("t0")) / 1000
    return two.select(KEY, "frame", (F.col("t0") + part * (F.col("t1") - F.col("t0"))).alias("t_ms"), F.when(part >= 0.5, F.col("frame")).otherwise(F.col("frame") - 1).alias("nearest"), F.when(dt > 0, F.abs(F.col("v1") - F.col("v0")) / dt).otherwise(0.0).alias("slope"))


def filled(s: DataFrame, column: str, into: str, nothing: float = 45.0) -> DataFrame:
    """Nulls between values by straight lines in frames, beyond them by the nearest value; a series without values is ``nothing``."""
    w = by()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.col("frame"))
    v0, v1 = F.last(column, ignorenulls=True).over(before), F.first(column, ignorenulls=True).over(after)
    f0, f1 = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
    out = s.withColumn("_v0", v0).withColumn("_v1", v1).withColumn("_f0", f0).withColumn("_f1", f1)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("frame") - F.col("_f0")) / (F.col("_f1") - F.col("_f0"))
    return out.withColumn(into, F.when(F.col("_f0") == F.col("_f1"), F.col("_v0")).otherwise(F.coalesce(line, "_v0", "_v1", F.lit(nothing)))).drop("_v0", "_v1", "_f0", "_f1")


def resampled(s: DataFrame, column: str, rate: float) -> DataFrame:
    """video_id, step, t_ms, value: the series at a uniform rate, times from 0; steps divide the duration evenly."""
    w = by()
    ends = whole()
    z = s.select(KEY, "frame", (F.col("t_ms") - F.min("t_ms").over(ends)).alias("t0"), F.col(column).alias("v0"))
    z = z.withColumn("t1", F.lead("t0").over(w)).withColumn("v1", F.lead("v0").over(w)).withColumn("total", F.max("t0").over(ends))
    n = F.floor(F.col("total") / (1000.0 / rate)).cast("long") + 1
    z = z.withColumn("n", n).withColumn("gap", F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)).otherwise(F.col("total") + 1))
    # A target lies in the step that begins at or before it; the last frame holds the last target alone.
    low = F.ceil(F.col("t0") / F.col("gap") - 1e-9)
    high = F.when(F.col("t1").isNull(), F.col("n") - 1).otherwise(F.ceil(F.col("t1") / F.col("gap") - 1e-9) - 1)
    made = z.where(high >= low).select("*", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("step")).where("step < n")
    t = F.col("step") * F.col("gap")
    value = F.when(F.col("t1").isNull() | (F.col("t1") <= F.col("t0")), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (t - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return made.select(KEY, "step", t.alias("t_ms"), value.alias("value"))


def sequence_gaps(f: DataFrame) -> DataFrame:
    """session_id, camera_id, start_ns, end_ns, missing, after_index of every hole in the sequence numbers of a camera's frames."""
    w = Window.partitionBy("session_id", "camera_id").orderBy("sequence")
    g = f.select("session_id", "camera_id", F.lag("ts_ns").over(w).alias("start_ns"), F.col("ts_ns").alias("end_ns"), (F.col("sequence") - F.lag("sequence").over(w) - 1).alias("missing"), (F.row_number().over(w) - 2).alias("after_index"))
    return g.where("missing > 0")


def order_violations(f: DataFrame) -> DataFrame:
    """Frames of a camera, by arrival, whose time or sequence number does not come after the frame before: rule names them."""
    w = Window.partitionBy("session_id", "camera_id").orderBy("arrival")
    dt, ds = F.col("ts_ns") - F.lag("ts_ns").over(w), F.col("sequence") - F.lag("sequence").over(w)
    rule = F.when(dt == 0, "duplicate timestamp").when(dt < 0, "backward timestamp").when(ds <= 0, "sequence does not increase")
    return f.withColumn("rule", rule).where("rule is not null")


def retained(f: DataFrame, retention_ns: int, most_bytes: int) -> DataFrame:
    """Frames of each camera within the retention of its newest and, from the newest, within a number of bytes; the newest always."""
    cam = Window.partitionBy("session_id", "camera_id")
    newest = cam.orderBy(F.col("ts_ns").desc(), F.col("sequence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = f.withColumn("_age", F.max("ts_ns").over(cam) - F.col("ts_ns")).withColumn("_sum", F.sum("bytes").over(newest)).withColumn("_k", F.count("*").over(newest))
    return out.where((F.col("_k") == 1) | ((F.col("_age") <= retention_ns) & (F.col("_sum") <= most_bytes))).drop("_age", "_sum", "_k")


def position_order_warnings(pos: DataFrame) -> DataFrame:
    """Positions whose frame is before that of the position that comes before them."""
    w = Window.partitionBy(KEY).orderBy("rank")
    p = pos.withColumn("rank", F.substring("p", 2, 9).cast("int"))
    return p.withColumn("before", F.lag("predicted").over(w)).where("predicted < before").select(KEY, "p", "predicted", "before")


def active_segments(s: DataFrame, threshold: float, column: str = "speed") -> DataFrame:
    """video_id, start, end, peak of every run of frames above a threshold."""
    w = by()
    on = F.col(column) > threshold
    m = s.withColumn("_on", on).withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    m = m.withColumn("_id", F.sum("_new").over(w)).where("_on")
    return m.groupBy(KEY, "_id").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.max(column).alias("peak")).drop("_id")


def settle_frame(s: DataFrame, column: str = "speed", times: float = 1.5) -> DataFrame:
    """video_id, settled: the first frame from which five values in a row are under so many times the 30th percentile; null if none."""
    calm = F.percentile(column, F.lit(0.3)).over(whole()) * times
    ahead = by().rowsBetween(0, 4)
    m = s.withColumn("_calm", calm).withColumn("_most", F.max(column).over(ahead)).withColumn("_n", F.count("*").over(ahead))
    return m.groupBy(KEY).agg(F.min(F.when((F.col("_n") == 5) & (F.col("_most") < F.col("_calm")), F.col("frame"))).alias("settled"))
