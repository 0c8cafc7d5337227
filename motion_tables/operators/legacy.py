"""The older position detector, which splits a swing by proportions, and the merge of two views' detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.catalog import reasons
from motion_tables.operators.windows import KEY, by, whole

NAMES = [f"P{i}" for i in range(1, 11)]


def series(p: DataFrame) -> DataFrame:
    """Per frame: speed (of wrists, elbows and shoulders, weighted, smoothed over five), arm_height and wrist_height, climb (smoothed change of the arm's height, positive downward), and the recording's frames n."""
    lm, w = F.col("lm"), by()
    dt = P.clipped(F.col("t_ms") - F.lag("t_ms").over(w), 1.0, 100.0)
    pairs = {"wrist": (P.L_WRIST, P.R_WRIST, 0.5), "elbow": (P.L_ELBOW, P.R_ELBOW, 0.3), "shoulder": (P.L_SHOULDER, P.R_SHOULDER, 0.2)}
    out = p.select(KEY, "frame", "t_ms", dt.alias("dt"), *[P.mid(P.at(lm, a), P.at(lm, b), k).alias(f"{n}_{k}") for n, (a, b, _) in pairs.items() for k in "xy"])
    moved = [share * F.hypot(*[F.col(f"{n}_{k}") - F.lag(f"{n}_{k}").over(w) for k in "xy"]) for n, (_, _, share) in pairs.items()]
    out = out.withColumn("moved", F.coalesce((moved[0] + moved[1] + moved[2]) * 33.33 / F.col("dt"), F.lit(0.0))).withColumn("arm_height", (F.col("wrist_y") + F.col("elbow_y")) / 2)
    out = out.withColumn("risen", F.coalesce((F.col("arm_height") - F.lag("arm_height").over(w)) * 33.33 / F.col("dt"), F.lit(0.0)))
    mean = lambda c, k: F.sum(c).over(w.rowsBetween(-k, k)) / (2 * k + 1)
    return out.select(KEY, "frame", mean("moved", 2).alias("speed"), "arm_height", F.col("wrist_y").alias("wrist_height"), mean("risen", 3).alias("climb"), F.count("*").over(whole()).alias("n"))


def descents(s: DataFrame, threshold: float = 0.0005, frames: int = 5) -> DataFrame:
    """s with ``falling``: whether the arms go down on this frame and the four after it."""
    w = by().rowsBetween(0, frames - 1)
    return s.withColumn("falling", (F.min("climb").over(w) > threshold) & (F.count("*").over(w) == frames))


def legacy_positions(p: DataFrame) -> DataFrame:
    """video_id, p, frame of P1 to P10: impact where the upper body is fastest, top where the arms are highest before it, address where they last came down before the climb, finish where it is still again; the others in proportion.

    A recording of under 20 frames has P1, P4, P6, P9 and P10 in proportion alone.  All steps are windows over one partitioning.
    """
    every, f = whole(), F.col("frame")
    s = descents(series(p))
    least = lambda cond, v: F.min_by("frame", F.when(cond, F.struct(F.round(v, 9), f))).over(every)
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c))).over(every)
    whole_part = lambda c: F.floor(c).cast("long")
    s = s.withColumn("p6", least(F.lit(True), -F.col("speed")))
    low, high = F.greatest(F.lit(10), whole_part(F.col("p6") * 0.2)), whole_part(F.col("p6") * 0.95)
    half = F.greatest(F.lit(1), whole_part(F.col("p6") / 2))
    s = s.withColumn("top", F.when((F.col("p6") > 20) & (high > low), least((f >= low) & (f < high), F.col("arm_height"))).otherwise(half))
    at = F.max(F.when(f == F.col("top"), F.col("arm_height"))).over(every)
    before, after = mean((f >= F.col("top") - 10) & (f < F.col("top")), "arm_height"), mean((f >= F.col("top")) & (f < F.least("p6", F.col("top") + 10)), "arm_height")
    s = s.withColumn("peak", (at < before) & (at < after)).withColumn("highest", least(f < F.col("p6"), F.col("wrist_height")))
    s = s.withColumn("p4", F.when((F.col("top") > 5) & (F.col("top") < F.col("p6") - 5) & ~F.col("peak"), F.col("highest")).otherwise(F.col("top")))
    s = s.withColumn("down", F.max(F.when(F.col("falling") & (f + 4 <= F.col("p4") - 15), f)).over(every))
    still = (f >= F.col("down")) & (f < F.least(F.col("down") + 20, F.col("p4") - 15))
    p1 = F.coalesce(least(still, F.col("speed")), F.col("down") + 5, F.lit(0))
    s = s.withColumn("p1", p1).withColumn("p1", F.when(F.col("p4") - F.col("p1") < 20, F.greatest(F.lit(0), F.col("p4") - 30)).otherwise(F.col("p1")))
    s = s.withColumn("calm", F.percentile("speed", F.lit(0.3)).over(every) * 1.5).withColumn("ahead", F.max("speed").over(by().rowsBetween(0, 4)))
    settled = F.min(F.when((f >= F.col("p6") + 20) & (f + 5 < F.col("n")) & (F.col("ahead") < F.col("calm")), f)).over(every)
    s = s.withColumn("p9", F.greatest(F.col("p6") + 30, F.least(F.coalesce(settled, F.col("n") - 1), F.col("n") - 1)))
    one = s.where("frame = 0").select(KEY, "n", "p1", "p4", "p6", "p9")
    part = lambda a, b, k, m: F.col(a) + F.floor((F.col(b) - F.col(a)) * k / m)
    end = F.col("n") - 1
    p2, p3, p7, p8 = part("p1", "p4", 1, 3), part("p1", "p4", 2, 3), part("p6", "p9", 1, 3), part("p6", "p9", 2, 3)
    p10 = F.greatest(F.col("p9") + 15, F.col("p9") + F.floor((end - F.col("p9")) * 9 / 10))
    full = [F.greatest(F.lit(0), "p1"), F.greatest(F.col("p1") + 1, p2), F.greatest(p2 + 1, p3), F.col("p4"), F.greatest(F.col("p4") + 1, part("p4", "p6", 1, 2)), F.col("p6"), F.greatest(F.col("p6") + 1, p7), F.greatest(p7 + 1, p8), F.least("p9", end), F.least(p10, end)]
    short = {"P1": F.lit(0), "P4": F.floor(F.col("n") / 3), "P6": F.floor(F.col("n") / 2), "P9": end, "P10": end}
    row = lambda name, c: F.struct(F.lit(name).alias("p"), c.cast("long").alias("frame"))
    rows = F.when(F.col("n") < 20, F.array(*[row(k, v) for k, v in short.items()])).otherwise(F.array(*[row(k, v) for k, v in zip(NAMES, full)]))
    return one.select(KEY, F.explode(rows).alias("r")).select(KEY, "r.*")


def aligned_views(pairs: DataFrame) -> DataFrame:
    """Pairs of views (pair_id, and fps, frames and impact_ms, null if not found, of each as f_ face on and d_ down the line) with alignment, offset_ms (of the second view's clock) and warnings.

    Views of equal rate and length were triggered together; else they are aligned on their impacts, or not at all.
    """
    together = (F.abs(F.col("f_fps") - F.col("d_fps")) < 0.5) & (F.col("f_frames") == F.col("d_frames"))
    both = F.col("f_impact_ms").isNotNull() & F.col("d_impact_ms").isNotNull()
    drift = F.col("d_impact_ms") - F.col("f_impact_ms")
    alignment = F.when(together, "shared-trigger").when(both, "impact").otherwise("none")
    warnings = reasons((together & (F.abs(drift) > 40), "impacts apart on views triggered together"), (~together & both, "views not frame-aligned; aligned on impact"), (~together & ~both & F.col("f_impact_ms").isNull(), "impact not found face on"), (~together & ~both & F.col("f_impact_ms").isNotNull(), "impact not found down the line"))
    return pairs.select("pair_id", alignment.alias("alignment"), F.when(together, 0.0).when(both, drift).alias("offset_ms"), warnings.alias("warnings"))


def merged_views(detections: DataFrame, alignment: DataFrame) -> DataFrame:
    """The detections of both views (pair_id, view, tier, p, t_ms, confidence) as one on the face-on clock: pair_id, p, view, t_ms, confidence, warning.

    Of the kinematic tier the more sure view stands, face on if equal, with a warning where they are over 50 ms apart; the arm's positions come from face on, the shaft's from down the line.
    Down the line counts only where the views are aligned.
    """
    d = detections.join(alignment.select("pair_id", "alignment", "offset_ms"), "pair_id")
    face = F.col("view") == "face_on"
    d = d.withColumn("t_ms", F.when(face, F.col("t_ms")).otherwise(F.col("t_ms") - F.col("offset_ms"))).where("t_ms is not null")
    d = d.where(((F.col("tier") == "kinematic")) | ((F.col("tier") == "arm") & face) | ((F.col("tier") == "shaft") & ~face))
    best = F.min_by(F.struct("view", "t_ms", "confidence"), F.struct(-F.col("confidence"), (~face).cast("int")))
    g = d.groupBy("pair_id", "p", "tier", "alignment").agg(best.alias("b"), F.count("*").alias("views"), (F.max("t_ms") - F.min("t_ms")).alias("spread"))
    apart = (F.col("tier") == "kinematic") & (F.col("views") == 2) & (F.col("spread") > 50) & ~((F.col("alignment") == "impact") & (F.col("p") == "P7"))
    return g.select("pair_id", "p", "b.view", "b.t_ms", "b.confidence", F.when(apart, "views disagree").alias("warning"))
