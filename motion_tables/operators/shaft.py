"""The club's shaft: gaps in its track, its angular speed, and positions read from its angle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.windows import KEY, by, filled, moving_average, whole

# Degrees from the upright at which a shaft counts as level, and how far off; bounds of a believable share of frames with a shaft.
LEVEL, OFF = 80.0, 15.0
FEW, MANY = 0.3, 0.9
ENDS = ("x1", "y1", "x2", "y2")


def whole_number(c: Column) -> Column:
    """A double without its fraction, towards 0."""
    return c.cast("long")


def smoothed_track(s: DataFrame, most_gap: int = 3, reach: int = 3) -> DataFrame:
    """A track of segments (video_id, frame, x1..y2 whole numbers, null where none was found) with gaps of up to ``most_gap`` frames between finds filled by straight lines, then each find the mean of those within ``reach`` frames; cut to whole numbers."""
    before, after = by().rowsBetween(Window.unboundedPreceding, 0), by().rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("x1").isNotNull(), F.struct("frame", *ENDS))
    t = s.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    gap = F.col("_b.frame") - F.col("_a.frame")
    part = (F.col("frame") - F.col("_a.frame")) / gap
    small = F.col("x1").isNull() & (gap - 1 <= most_gap)
    for c in ENDS:
        t = t.withColumn(f"_{c}", F.when(small, whole_number(F.col(f"_a.{c}") + part * (F.col(f"_b.{c}") - F.col(f"_a.{c}")))).otherwise(F.col(c)))
    near = by().rowsBetween(-reach, reach)
    return t.select(KEY, "frame", *[F.when(F.col(f"_{c}").isNotNull(), whole_number(F.avg(f"_{c}").over(near))).alias(c) for c in ENDS])


def angles(s: DataFrame) -> DataFrame:
    """video_id, frame, found, angle (degrees from the upright; between finds by straight lines, 45 if there are none)."""
    own = s.select(KEY, "frame", F.col("x1").isNotNull().alias("found"), P.club_angle(*[F.col(c) for c in ENDS]).alias("own"))
    return filled(own, "own", "angle").select(KEY, "frame", "found", "angle")


def detection_confidence(s: DataFrame) -> DataFrame:
    """video_id, frames, rate (share of frames with a shaft), confidence: low for a rate so high that it must be edges of the body, or too low to follow."""
    g = s.groupBy(KEY).agg(F.count("*").alias("frames"), F.avg(F.col("x1").isNotNull().cast("double")).alias("rate"))
    return g.withColumn("confidence", F.when(F.col("rate") > MANY, 0.3).when(F.col("rate") < FEW, 0.2).otherwise(0.5 + (F.col("rate") - FEW) * 0.5))


def impact(s: DataFrame) -> DataFrame:
    """video_id, impact: the frame of the fastest turn of the shaft, smoothed over five frames; null in recordings under ten frames, with too few or too many finds, or if it is in the first or last tenth."""
    a = angles(s)
    turned = a.withColumn("turn", F.coalesce(F.abs(F.col("angle") - F.lag("angle").over(by())), F.lit(0.0)))
    g = moving_average(turned, "turn", 5, "speed").groupBy(KEY).agg(F.count("*").alias("n"), F.avg(F.col("found").cast("double")).alias("rate"), F.min_by("frame", F.struct(-F.round("speed", 9), "frame")).alias("at"))
    ok = (F.col("n") >= 10) & F.col("rate").between(FEW, MANY) & (F.col("at") >= F.col("n") * 0.1) & (F.col("at") <= F.col("n") * 0.9)
    return g.select(KEY, F.when(ok, F.col("at")).alias("impact"))


def refined_positions(s: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (video_id, p1, p4, p6, p9) with the impact moved to where the shaft is most upright near it, and p2 and p7, the first frames of a level shaft on the way back and through.

    Adds rate, confidence, p2, p7; positions stay, without p2 and p7, if the confidence is under 0.4, and each refined one counts only between its neighbours.
    """
    a = angles(s).join(positions, KEY)
    f, angle = F.col("frame"), F.round("angle", 9)
    low, high = F.greatest("p4", F.col("p6") - 15), F.least("p9", F.col("p6") + 15)
    back = (f >= F.col("p1")) & (f < F.col("p4"))
    pick = lambda cond, by_: F.min_by("frame", F.when(cond, F.struct(by_, f)))
    first = a.groupBy(KEY, "p1", "p4", "p6", "p9").agg(
        F.coalesce(F.min(F.when(back & (F.col("angle") >= LEVEL - OFF), f)), pick(back, F.abs(angle - LEVEL))).alias("q2"),
        pick((f >= low) & (f < high), angle).alias("q6"), F.min(F.when((f >= low) & (f < high), F.col("angle"))).alias("upright"),
        F.avg(F.col("found").cast("double")).alias("rate"),
    )
    first = first.withColumn("q6", F.coalesce("q6", "p6"))
    late = (f > F.col("q6") + 5) & (f < F.col("p9")) & (F.col("angle") >= LEVEL - OFF)
    out = a.select(KEY, "frame", "angle").join(first, KEY).groupBy(*first.columns).agg(F.min(F.when(late, f)).alias("q7"))
    base = F.when(F.col("rate") > MANY, 0.3).when(F.col("rate") < FEW, 0.2).otherwise(0.5 + (F.col("rate") - FEW) * 0.5)
    sure = F.when(F.col("upright") < 45, 1 - F.col("upright") / 90).otherwise(0.3)
    out = out.withColumn("confidence", base * (0.5 + sure * 0.5))
    ok = F.col("confidence") >= 0.4
    between = lambda q, lo, hi: ok & (F.col(q) > lo) & (F.col(q) < hi)
    p6 = F.when(between("q6", F.col("p4"), F.col("p9")), F.col("q6")).otherwise(F.col("p6"))
    return out.select(KEY, "rate", "confidence", "p1", F.when(between("q2", F.col("p1"), F.col("p4")), F.col("q2")).alias("p2"), "p4", p6.alias("p6"), F.when(between("q7", p6, F.col("p9")), F.col("q7")).alias("p7"), "p9")


def local_refinements(p: DataFrame, transferred: DataFrame) -> DataFrame:
    """Transferred positions (video_id, p1, p4, p6, p7, p9) put right by what is seen around them: video_id, p, frame, confidence, method.

    The top is where the wrists are highest within 10 frames, the impact where they are fastest within 15, the follow-through the second peak of speed in the
    15 frames from the fifth after it, or a third of the way there.  P2, P3, P5 and P8 are placed between; each position is at least a frame after the one before it.
    """
    from motion_tables.operators.windows import wrist_velocity

    lm = F.col("lm")
    s = wrist_velocity(p).withColumn("height", P.mid(P.at(lm, P.L_WRIST), P.at(lm, P.R_WRIST), "y")).withColumn("n", F.count("*").over(whole())).select(KEY, "frame", "n", "velocity", "height").join(transferred, KEY)
    f = F.col("frame")
    near4, near6 = (f >= F.col("p4") - 10) & (f < F.col("p4") + 10), (f >= F.col("p6") - 15) & (f < F.col("p6") + 15)
    at = lambda cond, v: F.min_by("frame", F.when(cond, F.struct(F.round(v, 9), f)))
    of = lambda how, cond, c: how(F.when(cond, F.col(c)))
    count = lambda cond: F.sum(cond.cast("int"))
    keys = [KEY, "n", "p1", "p4", "p6", "p9"]
    g = s.groupBy(*keys).agg(
        at(near4, F.col("height")).alias("q4"), F.when(count(near4) >= 3, F.least(F.lit(1.0), (of(F.avg, near4, "height") - of(F.min, near4, "height")) / 0.1 + 0.5)).otherwise(0.5).alias("c4"),
        at(near6, -F.col("velocity")).alias("q6"), F.when(count(near6) >= 3, F.least(F.lit(1.0), of(F.max, near6, "velocity") / (of(F.avg, near6, "velocity") + 0.01))).otherwise(0.5).alias("c6"),
    )
    g = g.withColumn("c4", F.when(F.col("q4").isNull(), 0.5).otherwise(F.col("c4"))).withColumn("q4", F.coalesce("q4", "p4")).withColumn("c6", F.when(F.col("q6").isNull(), 0.5).otherwise(F.col("c6"))).withColumn("q6", F.coalesce("q6", "p6"))
    near7 = (f >= F.col("q6") + 5) & (f < F.col("q6") + 20)
    h = s.select(KEY, "frame", "velocity").join(g, KEY).groupBy(*g.columns).agg(at(near7, -F.col("velocity")).alias("q7"), count(near7).alias("k7"), of(F.max, near7, "velocity").alias("top"), of(F.avg, near7, "velocity").alias("mean"))
    sharp = F.col("top") > F.col("mean") * 1.2
    third = F.col("q6") + 5 + F.floor(F.col("k7") / 3)
    h = h.withColumn("q7", F.when(F.col("k7") == 0, F.least(F.col("q6") + 10, F.col("n") - 1)).when((F.col("k7") < 3) | sharp, F.col("q7")).otherwise(third))
    h = h.withColumn("c7", F.when(F.col("k7") == 0, 0.3).when((F.col("k7") >= 3) & sharp, 0.7).otherwise(0.4))
    part = lambda a, b, k, m: a + F.floor((b - a) * k / m)
    p1, p4, p6, p9 = F.col("p1"), F.col("q4"), F.col("q6"), F.col("p9")
    rows = [
        ("P1", p1, F.lit(0.8), "dtw_transfer"), ("P2", part(p1, p4, 1, 3), F.lit(0.6), "interpolated"), ("P3", part(p1, p4, 2, 3), F.lit(0.6), "interpolated"), ("P4", p4, F.col("c4"), "hand_height_peak"),
        ("P5", part(p4, p6, 1, 2), F.lit(0.6), "interpolated"), ("P6", p6, F.col("c6"), "velocity_peak"), ("P7", F.col("q7"), F.col("c7"), "velocity_pattern"), ("P8", part(p6, p9, 2, 3), F.lit(0.5), "interpolated"), ("P9", p9, F.lit(0.7), "dtw_transfer"),
    ]
    ordered = [F.greatest(*[r[1].cast("long") + (i - j) for j, r in enumerate(rows[: i + 1])]) if i else rows[0][1].cast("long") for i in range(len(rows))]  # at least one after each before
    made = F.array(*[F.struct(F.lit(p_).alias("p"), o.alias("frame"), c.cast("double").alias("confidence"), F.lit(m).alias("method")) for (p_, _, c, m), o in zip(rows, ordered)])
    return h.select(KEY, F.explode(made).alias("r")).select(KEY, "r.*")
