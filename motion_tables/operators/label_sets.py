"""Building a set of frames to label: frames where two backends disagree most, and the proposals that labellers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.operators.windows import KEY, by


def disagreement(points: DataFrame, scales: DataFrame) -> DataFrame:
    """video_id, frame, apart: mean distance in scales (video_id, scale) of the joints that two backends (points: backend, joint, x, y, valid) both see there."""
    side = lambda b, c: F.max(F.when((F.col("backend") == b) & F.col("valid"), F.col(c)))
    j = points.groupBy(KEY, "frame", "joint").agg(*[side(b, c).alias(f"{b}_{c}") for b in "ab" for c in "xy"]).where("a_x is not null and b_x is not null")
    d = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    return j.groupBy(KEY, "frame").agg(F.avg(d).alias("apart")).join(scales, KEY).select(KEY, "frame", (F.col("apart") / F.col("scale")).alias("apart"))


def picked_frames(apart: DataFrame, speeds: DataFrame, annotated: DataFrame, windows: DataFrame) -> DataFrame:
    """video_id, frame, why: the annotated frames (video_id, p, frame), the two of most disagreement within the window (video_id, low, high) that are far enough from those before them, and the fastest if P7 is not annotated.

    Far enough is a tenth of the window, five frames at least; three for the fastest.  Ties go to the earlier frame.
    """
    held = windows.join(annotated.groupBy(KEY).agg(F.collect_list("frame").alias("taken"), F.max((F.col("p") == "P7").cast("int")).alias("hit")), KEY, "left")
    held = held.select(KEY, "low", "high", F.coalesce("taken", F.array().cast("array<long>")).alias("taken"), F.coalesce("hit", F.lit(0)).alias("hit"), F.greatest(F.lit(5), F.floor((F.col("high") - F.col("low")) / 10)).alias("gap"))
    inside = (F.col("frame") >= F.col("low")) & (F.col("frame") < F.col("high"))
    far = lambda gap: F.forall("taken", lambda t: F.abs(F.col("frame") - t) >= gap)
    best = lambda v: F.min_by("frame", F.struct(-F.round(v, 9), F.col("frame")))
    out = annotated.select(KEY, "frame", "p", F.col("p").alias("why"))
    out = out.drop("p")
    for _ in range(2):
        pick = apart.join(held, KEY).where(inside & far(F.col("gap"))).groupBy(KEY).agg(best(F.col("apart")).alias("frame"))
        out = out.unionByName(pick.withColumn("why", F.lit("backends disagree")))
        held = held.join(pick, KEY, "left").withColumn("taken", F.when(F.col("frame").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array(F.col("frame").cast("long"))))).drop("frame")
    fast = speeds.join(held.where("hit = 0"), KEY).where(inside).groupBy(KEY, "taken").agg(best(F.col("speed")).alias("frame")).where(far(F.lit(3)))
    return out.unionByName(fast.select(KEY, "frame", F.lit("fastest").alias("why")))


def hand_speeds(points: DataFrame, joint: int) -> DataFrame:
    """video_id, frame, speed: how far a joint (x, y) goes to the next frame."""
    w = by()
    p = points.where(F.col("joint") == joint)
    step: Column = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    return p.select(KEY, "frame", step.alias("speed")).where("speed is not null")


def proposals(points: DataFrame, scales: DataFrame) -> DataFrame:
    """video_id, frame, joint, a and b (what each backend proposes, to a tenth, null if it does not see the joint) and disagree, their distance in scales; joints that neither sees have no row."""
    at = lambda b: F.max(F.when((F.col("backend") == b) & F.col("valid"), F.struct(F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))))
    g = points.groupBy(KEY, "frame", "joint").agg(at("a").alias("a"), at("b").alias("b")).where("a is not null or b is not null").join(scales, KEY, "left")
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) / F.col("scale")
    return g.select(KEY, "frame", "joint", F.col("a.x").alias("a_x"), F.col("a.y").alias("a_y"), F.col("b.x").alias("b_x"), F.col("b.y").alias("b_y"), F.round(d, 3).alias("disagree"))
