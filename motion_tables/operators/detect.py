"""Finding the active window of a recording and key positions in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions.pose import clipped, slope_confidence
from motion_tables.operators.windows import KEY, by, crossings, moving_average, whole

SLOPE = 0.15
GUARD_MS = 40.0


def baseline(s: DataFrame, column: str, duration_ms: float = 1000.0) -> DataFrame:
    """s with median and mad of the leading frames: those up to the duration, but ten at least and a third of all at most; mad at least 0.001."""
    all_ = whole()
    n = F.count("*").over(all_)
    late = F.min(F.when(F.col("t_ms") > duration_ms, F.col("frame"))).over(all_)
    end = F.greatest(F.lit(10), F.least(F.greatest(F.coalesce(late, n), F.lit(1)), F.floor(n / 3)))
    out = s.withColumn("_lead", F.col("frame") < end)
    out = out.withColumn("median", F.median(F.when(F.col("_lead"), F.col(column))).over(all_))
    return out.withColumn("mad", F.greatest(F.median(F.when(F.col("_lead"), F.abs(F.col(column) - F.col("median")))).over(all_), F.lit(0.001))).drop("_lead")


def bursts(s: DataFrame, column: str, start_mad: float = 3.0, keep_mad: float = 1.5, least: int = 5) -> DataFrame:
    """video_id, start, end, peak, t_start, t_end, median, mad of every burst: it begins above the higher threshold and ends at the first frame under the lower one, which
    belongs to it; one that is still open at the end ends with the last frame."""
    w, all_ = by(), whole()
    mark = F.when(F.col(column) > F.col("median") + start_mad * F.col("mad"), 1).when(F.col(column) < F.col("median") + keep_mad * F.col("mad"), 0)
    m = s.withColumn("_on", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    new = (F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0)
    m = m.withColumn("_new", new.cast("int")).withColumn("_id", F.sum("_new").over(w)).withColumn("_next", F.lead("t_ms").over(w)).withColumn("_n", F.count("*").over(all_))
    g = m.where("_on = 1").groupBy(KEY, "_id").agg(
        F.min("frame").alias("start"), F.max("frame").alias("_last"), F.max(column).alias("peak"), F.min_by("t_ms", "frame").alias("t_start"), F.max_by("t_ms", "frame").alias("_t_last"), F.max_by("_next", "frame").alias("_t_next"), *[F.first(c).alias(c) for c in ("median", "mad", "_n")]
    )
    closed = F.col("_last") < F.col("_n") - 1
    g = g.withColumn("end", F.when(closed, F.col("_last") + 1).otherwise(F.col("_last"))).withColumn("t_end", F.coalesce("_t_next", "_t_last"))
    length = F.when(closed, F.col("end") - F.col("start")).otherwise(F.col("_n") - F.col("start"))
    return g.where(length >= least).select(KEY, "start", "end", "peak", "t_start", "t_end", "median", "mad", F.col("_n").alias("n"))


def main_burst(b: DataFrame) -> DataFrame:
    """The burst of each recording with the best score of duration, speed and length; ties go to the later one."""
    d = F.col("t_end") - F.col("t_start")
    duration = F.when(d.between(500, 2000), 1.0).when(d.between(300, 3000), 0.7).otherwise(0.3)
    score = duration * 0.4 + F.least(F.col("peak") / 0.1, F.lit(1.0)) * 0.4 + F.least((F.col("end") - F.col("start")) / 100, F.lit(1.0)) * 0.2
    order = Window.partitionBy(KEY).orderBy(F.col("score").desc(), F.col("start").desc(), F.col("end").desc(), F.col("peak").desc())
    return b.withColumn("score", score).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def swing_window(s: DataFrame, column: str = "speed", least_frames: int = 30, pre_ms: float = 500.0) -> DataFrame:
    """video_id, start_frame, takeaway_frame, impact_frame, end_frame, confidence: the main burst of each recording of at least 30 frames, the stillest frame of
    the half second before it, and its fastest frame.  Recordings without a burst have no row.  One shuffle: all windows and the aggregations share the recording's key."""
    smooth = baseline(moving_average(s, column, 5, "smooth"), "smooth")
    main = main_burst(bursts(smooth, "smooth")).where(F.col("n") >= least_frames)
    f = smooth.select(KEY, "frame", "t_ms", "smooth").join(main, KEY)
    near = (F.col("frame") < F.col("start")) & ((F.col("frame") == F.col("start") - 1) | (F.col("t_start") - F.col("t_ms") <= pre_ms))
    inside = F.col("frame").between(F.col("start"), F.col("end"))
    out = f.groupBy(KEY, "start", "end", "peak", "median", "mad").agg(
        F.min_by(F.when(near, F.col("frame")), F.when(near, F.struct("smooth", "frame"))).alias("address"), F.max_by(F.when(inside, F.col("frame")), F.when(inside, F.struct(F.col("smooth"), -F.col("frame")))).alias("impact_frame")
    )
    return out.select(
        KEY, F.coalesce("address", F.greatest(F.lit(0), F.col("start") - 5)).cast("int").alias("start_frame"), F.col("start").alias("takeaway_frame"), "impact_frame", F.col("end").alias("end_frame"),
        F.least((F.col("peak") - F.col("median")) / F.col("mad") / 10, F.lit(1.0)).alias("confidence"),
    )


def kinematic(signals: DataFrame, window: DataFrame) -> DataFrame:
    """video_id, p, frame, confidence: address, top, impact and finish from the hand speed (hand_speed, valid) within a recording's window."""
    f = signals.select(KEY, "frame", "hand_speed", "valid").join(window.select(KEY, "start_frame", "takeaway_frame", "end_frame"), KEY)
    moving = F.col("valid") & F.col("frame").between(F.col("takeaway_frame"), F.col("end_frame"))
    f = f.withColumn("_m", moving)
    all_ = whole()
    impact = F.max_by(F.when(F.col("_m"), F.col("frame")), F.when(F.col("_m"), F.struct(F.col("hand_speed"), -F.col("frame")))).over(all_)
    f = f.withColumn("impact", impact)
    between = F.col("valid") & (F.col("frame") > F.col("takeaway_frame")) & (F.col("frame") < F.col("impact"))
    g = f.where("impact is not null").groupBy(KEY, "start_frame", "takeaway_frame", "end_frame", "impact").agg(
        F.max(F.when(F.col("frame") == F.col("impact"), F.col("hand_speed"))).alias("fast"), F.median(F.when(F.col("_m"), F.col("hand_speed"))).alias("typical"),
        F.max(F.when(F.col("frame") == F.col("start_frame"), F.col("hand_speed"))).alias("at_start"), F.max(F.when(F.col("frame") == F.col("end_frame"), F.col("hand_speed"))).alias("at_end"),
        F.min_by(F.when(between, F.col("frame")), F.when(between, F.struct("hand_speed", "frame"))).alias("top"), F.min(F.when(between, F.col("hand_speed"))).alias("slow"),
        F.max(F.when(F.col("frame").between(F.col("takeaway_frame"), F.col("impact")), F.col("hand_speed"))).alias("around"),
    )
    share = lambda a, b: F.when(b > 0, clipped(a / b, 0.0, 1.0)).otherwise(0.0)
    found = F.array(
        F.struct(F.lit("P1").alias("p"), F.col("start_frame").alias("frame"), share(F.col("fast") - F.col("at_start"), F.col("fast")).alias("confidence")),
        F.struct(F.lit("P4").alias("p"), F.col("top").alias("frame"), share(F.col("around") - F.col("slow"), F.col("around")).alias("confidence")),
        F.struct(F.lit("P7").alias("p"), F.col("impact").alias("frame"), share(F.col("fast") - F.col("typical"), F.col("fast")).alias("confidence")),
        F.struct(F.lit("P10").alias("p"), F.col("end_frame").alias("frame"), share(F.col("fast") - F.col("at_end"), F.col("fast")).alias("confidence")),
    )
    return g.select(KEY, F.explode(found).alias("f")).select(KEY, "f.*").where("frame is not null")


def lead_arm(signals: DataFrame, kin: DataFrame, column: str = "elevation") -> DataFrame:
    """video_id, p, frame, t_ms, confidence of P3, P5 and P9: the lead arm crosses the horizontal, not within 40 ms of the top or the impact."""
    anchors = kin.groupBy(KEY).pivot("p", ["P1", "P4", "P7", "P10"]).agg(F.first("frame")).dropna()
    step = signals.groupBy(KEY).agg(((F.max("t_ms") - F.min("t_ms")) / F.when(F.count("*") > 1, F.count("*") - 1)).alias("step"))
    guard = F.when(F.col("step") > 0, F.greatest(F.lit(1), F.bround(F.lit(GUARD_MS) / F.when(F.col("step") > 0, F.col("step"))).cast("int"))).otherwise(0)
    a = anchors.join(step, KEY).withColumn("g", guard)
    span = lambda p, lo, hi, last: F.struct(F.lit(p).alias("p"), lo.alias("lo"), hi.alias("hi"), F.lit(last).alias("last"))
    spans = F.array(span("P3", F.col("P1"), F.col("P4") - F.col("g"), True), span("P5", F.col("P4") + F.col("g"), F.col("P7") - F.col("g"), False), span("P9", F.col("P7") + F.col("g"), F.col("P10"), False))
    a = a.select(KEY, F.explode(spans).alias("s")).select(KEY, "s.*").where("hi > lo")
    c = crossings(signals, column, "valid").where(F.col("slope") >= SLOPE).join(a, KEY).where("frame > lo and frame <= hi")
    order = Window.partitionBy(KEY, "p").orderBy(F.when(F.col("last"), -F.col("frame")).otherwise(F.col("frame")))
    return c.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(KEY, "p", F.col("nearest").alias("frame"), "t_ms", slope_confidence(F.col("slope")).alias("confidence"))


def impact_by_wrists(p: DataFrame) -> DataFrame:
    """video_id, impact: the frame of the largest summed step of both wrists in the image, smoothed over five frames."""
    w = by()

    def moved(j: int):
        q = F.get("lm", F.lit(j))
        return F.hypot(q["x"] - F.lag(q["x"]).over(w), q["y"] - F.lag(q["y"]).over(w))

    s = moving_average(p.withColumn("v", F.coalesce(moved(5) + moved(6), F.lit(0.0))), "v", 5, "smooth")
    return s.groupBy(KEY).agg(F.max_by("frame", F.struct(F.round("smooth", 9), -F.col("frame"))).alias("impact"))


def blind_frames(frames: DataFrame, salt: str = "blind", per_video: int = 3) -> DataFrame:
    """Of each recording the frames that are labelled without proposals: the first position's, then by hash, three in all."""
    order = Window.partitionBy(KEY).orderBy(F.col("is_p1").desc(), F.sha1(F.concat(F.lit(salt), F.col("digest"))), "frame")
    return frames.withColumn("rank", F.row_number().over(order)).withColumn("blind", F.col("rank") <= per_video)


def pick_p1_p4_p7(s: DataFrame, height: str, speed: str = "speed", within_ms: float = 900.0) -> DataFrame:
    """video_id, p1, p4, p7: the stillest frame before the top, the top (least height), and the first nearly fastest frame soon after it."""
    g = s.groupBy(KEY).agg(F.min_by("frame", F.struct(height, "frame")).alias("p4"), F.min_by("t_ms", F.struct(height, "frame")).alias("t4"))
    f = s.join(g, KEY)
    before, after = F.col("frame") <= F.col("p4"), (F.col("frame") >= F.col("p4")) & (F.col("t_ms") <= F.col("t4") + within_ms)
    f = f.withColumn("_fast", F.max(F.when(after, F.col(speed))).over(whole()))
    return f.groupBy(KEY, "p4").agg(F.min_by(F.when(before, F.col("frame")), F.when(before, F.struct(speed, "frame"))).alias("p1"), F.min(F.when(after & (F.col(speed) >= F.col("_fast") * 0.95), F.col("frame"))).alias("p7")).select(KEY, "p1", "p4", "p7")
