"""Scores and summaries: errors against labels, behaviour of pose backends, rates and duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.windows import spike_deviation, swap_test, whole

SPIKE = 0.2
SWAP_RATIO, SWAP_MOTION = 0.5, 0.1
THRESHOLDS = (0.05, 0.1, 0.2)


def position_errors(pos: DataFrame) -> DataFrame:
    """Signed error of predicted against labelled frames, in frames and ms; positions without either are left out."""
    e = F.col("predicted") - F.col("labelled")
    return pos.where("predicted is not null and labelled is not null").withColumn("error_frames", e).withColumn("error_ms", e * 1000 / F.col("fps"))


def position_mae(errors: DataFrame) -> DataFrame:
    """Mean, population deviation and number of the absolute errors, by position and overall (p null), in one pass over grouping sets."""
    a, m = F.abs("error_frames"), F.abs("error_ms")
    return errors.groupingSets([[F.col("p")], []], F.col("p")).agg(F.avg(a).alias("mae_frames"), F.stddev_pop(a).alias("std_frames"), F.avg(m).alias("mae_ms"), F.count("*").alias("n"))


def _pck(t: float):
    return F.avg(F.when(F.col("err") <= t, 1.0).otherwise(0.0)).alias(f"pck_{t}".replace(".", "_"))


def error_aggregates() -> list:
    """n, missing rate, mean and median error, and the share of points within each threshold, a miss counting as outside."""
    return [F.count("*").alias("n"), F.avg(F.col("err").isNull().cast("int")).alias("missing"), F.avg("err").alias("mean_err"), F.median("err").alias("median_err"), *[_pck(t) for t in THRESHOLDS]]


def error_summary(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys).agg(*error_aggregates())


def group_summary(labels: DataFrame) -> DataFrame:
    """Errors of every backend and view, overall, by visibility and by joint, as grouping sets."""
    c = {k: F.col(k) for k in ("backend", "view", "visible", "joint")}
    two = [c["backend"], c["view"]]
    sets = [two, [*two, c["visible"]], [*two, c["joint"]]]
    grouped = F.grouping_id().alias("level")
    return labels.groupingSets(sets, *c.values()).agg(grouped, *error_aggregates())


def frame_counts(labels: DataFrame) -> DataFrame:
    """Of every backend: frames, frames of which every joint was missed, joints missed."""
    per = labels.groupBy("backend", "video_id", "frame").agg(F.count("*").alias("n"), F.count_if(F.col("err").isNull()).alias("missed"))
    return per.groupBy("backend").agg(F.count("*").alias("frames"), F.count_if(F.col("missed") == F.col("n")).alias("frames_missed"), F.sum("missed").alias("joints_missed"))


def coverage(labels: DataFrame) -> DataFrame:
    """Of every view: labelled points, hidden ones, videos, and points by backend as columns."""
    base = labels.groupBy("view").agg(F.count("*").alias("labelled"), F.count_if(~F.col("visible")).alias("hidden"), F.count_distinct("video_id").alias("videos"))
    wide = labels.groupBy("view").pivot("backend", ["F", "O"]).agg(F.count(F.lit(1))).withColumnsRenamed({"F": "points_f", "O": "points_o"})
    return base.join(wide, "view")


def with_validity(pts: DataFrame) -> DataFrame:
    return pts.withColumn("valid", P.is_valid(F.col("detected"), F.col("x"), F.col("y"), F.col("conf"), F.col("min_conf")))


def rates(pts: DataFrame) -> DataFrame:
    """Of every recording, backend and joint: share of frames with a detection, and with a valid point."""
    v = with_validity(pts)
    return v.groupBy("video_id", "backend", "joint").agg(F.avg(F.col("detected").cast("int")).alias("detection_rate"), F.avg(F.col("valid").cast("int")).alias("valid_rate"))


def torso_lengths(pts: DataFrame) -> DataFrame:
    """torso of every frame where both shoulders and hips are valid: a pivot of four named joints, one shuffle by frame."""
    names = {P.L_SHOULDER: "ls", P.R_SHOULDER: "rs", P.L_HIP: "lh", P.R_HIP: "rh"}
    v = with_validity(pts).where(F.col("joint").isin(*names) & F.col("valid"))
    pick = lambda j, a: F.max(F.when(F.col("joint") == j, F.col(a)))
    g = v.groupBy("video_id", "backend", "frame").agg(*[pick(j, a).alias(n + a) for j, n in names.items() for a in "xy"])
    t = F.hypot((F.col("lsx") + F.col("rsx") - F.col("lhx") - F.col("rhx")) / 2, (F.col("lsy") + F.col("rsy") - F.col("lhy") - F.col("rhy")) / 2)
    return g.select("video_id", "backend", "frame", t.alias("torso")).where("torso is not null")


def body_scales(pts: DataFrame) -> DataFrame:
    return torso_lengths(pts).groupBy("video_id", "backend").agg(F.median("torso").alias("scale"))


def spike_summary(pts: DataFrame) -> DataFrame:
    """Of every recording, backend and joint: 99th percentile of the spike deviation and share above 0.2, in body scales."""
    d = spike_deviation(with_validity(pts)).where("deviation is not null").join(body_scales(pts), ["video_id", "backend"])
    r = F.col("deviation") / F.col("scale")
    return d.groupBy("video_id", "backend", "joint").agg(F.percentile(r, F.lit(0.99)).alias("p99"), F.avg((r > SPIKE).cast("int")).alias("rate"))


def sides(pts: DataFrame) -> DataFrame:
    """Left and right points of each pair a frame: part, lx, ly, rx, ry, ok."""
    pairs = {"shoulder": (1, 2), "elbow": (3, 4), "wrist": (5, 6), "hip": (13, 14), "knee": (15, 16), "ankle": (17, 18)}
    part = F.create_map(*[F.lit(v) for k, (l, r) in pairs.items() for v in (l, k, r, k)])
    left = F.col("joint").isin(*[l for l, _ in pairs.values()])
    v = with_validity(pts).where(F.col("joint").isin(*[j for p in pairs.values() for j in p])).withColumn("part", part[F.col("joint")])
    pick = lambda c, side: F.max(F.when(side, F.col(c)))
    return v.groupBy("video_id", "backend", "part", "frame").agg(pick("x", left).alias("lx"), pick("y", left).alias("ly"), pick("x", ~left).alias("rx"), pick("y", ~left).alias("ry"), F.bool_and("valid").alias("ok"))


def swap_counts(pts: DataFrame) -> DataFrame:
    """Of every recording, backend and pair: frames at which left and right changed places, and frame pairs looked at."""
    t = swap_test(sides(pts)).join(body_scales(pts), ["video_id", "backend"])
    event = (F.col("keep") > SWAP_MOTION * F.col("scale")) & (F.col("swap") < SWAP_RATIO * F.col("keep"))
    return t.groupBy("video_id", "backend", "part").agg(F.count_if(event).alias("events"), F.count("keep").alias("checked"))


def agreement(pts: DataFrame) -> DataFrame:
    """Of every recording and joint: median distance of two backends' valid points in scales of the first; one shuffle by point instead of a self-join."""
    v = with_validity(pts).where("valid")
    pick = lambda c, b: F.max(F.when(F.col("backend") == b, F.col(c)))
    g = v.groupBy("video_id", "frame", "joint").agg(*[pick(c, b).alias(b + c) for b in "ab" for c in "xy"]).dropna()
    g = g.join(body_scales(pts).where("backend = 'a'").select("video_id", "scale"), "video_id")
    return g.groupBy("video_id", "joint").agg(F.median(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / F.col("scale")).alias("median_distance"), F.count("*").alias("n"))


def behaviour(pts: DataFrame) -> DataFrame:
    """Of every recording and backend: mean rates, median spike percentile and number of swaps."""
    key = ["video_id", "backend"]
    r = rates(pts).groupBy(*key).agg(F.avg("detection_rate").alias("detection_rate"), F.avg("valid_rate").alias("valid_rate"))
    s = spike_summary(pts).groupBy(*key).agg(F.median("p99").alias("median_p99"))
    return r.join(s, key, "left").join(swap_counts(pts).groupBy(*key).agg(F.sum("events").alias("swaps")), key, "left")


def frame_rate(s: DataFrame, time: str = "raw_ms") -> DataFrame:
    """Of every recording: the rate of its median step (60 if it has none), its average rate, and whether its steps vary by over 2 %."""
    d = F.col(time) - F.lag(time).over(Window.partitionBy("video_id").orderBy("frame"))
    g = s.withColumn("d", d).groupBy("video_id").agg(F.median("d").alias("m"), F.avg("d").alias("a"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    rate = lambda c: F.when(F.col(c) > 0, 1000 / F.when(F.col(c) > 0, F.col(c))).otherwise(60.0)
    return g.select("video_id", rate("m").alias("fps"), rate("a").alias("average_fps"), F.coalesce((F.col("hi") - F.col("lo")) > 0.02 * F.col("a"), F.lit(False)).alias("variable"))


def z_scores(features: DataFrame) -> DataFrame:
    """value of every feature (video_id, frame, feature, value) in deviations from its recording's mean; a deviation under 1e-8 counts as 1."""
    w = whole(["video_id", "feature"])
    std = F.stddev_pop("value").over(w)
    return features.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.when(std < 1e-8, 1.0).otherwise(std))


def repeated_images(files: DataFrame) -> DataFrame:
    """Digests that several rows of a group share (grp, id, digest): how many, and which ids in order."""
    return files.groupBy("grp", "digest").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


def _uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number from 0 to 1 of each key and a draw."""
    x = keys + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def paired_bootstrap(labels: DataFrame, first: str, second: str, threshold: float, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Of every view: difference of two backends' shares within a threshold (second less first) with its 95 % interval, resampling frames.

    Labels are first summed by frame (one shuffle); a view's frames are two counts each, and a view's resampling draws one Poisson weight a frame and
    draw, so it needs no more than one block of frames at a time.  A weight comes from a hash of seed, frame and draw: neither partitions nor blocks change it.  Frames scored for one backend only are left out.
    """
    hit = lambda b: F.count_if((F.col("backend") == b) & (F.col("err") <= threshold))
    of = lambda b: F.count_if(F.col("backend") == b)
    per = labels.groupBy("view", "video_id", "frame").agg(hit(first).alias("h1"), of(first).alias("n1"), hit(second).alias("h2"), of(second).alias("n2")).where("n1 > 0 and n2 > 0").withColumn("key", F.xxhash64("view", "video_id", "frame", F.lit(seed)))
    likely = np.cumsum(np.exp(-1.0) / np.array([1.0, *np.cumprod(np.arange(1.0, 16.0))]))  # of Poisson weights up to each number

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            for view, g in block.groupby("view", sort=False):
                counts = g[["h1", "n1", "h2", "n2"]].to_numpy(np.float64)
                keys = g["key"].to_numpy(np.int64).view(np.uint64)
                sums = np.stack([np.searchsorted(likely, _uniform(keys, k)) @ counts for k in range(draws)])
                yield pd.DataFrame({"view": view, "draw": np.arange(-1, draws), **{c: np.concatenate([[counts[:, i].sum()], sums[:, i]]) for i, c in enumerate(("h1", "n1", "h2", "n2"))}})

    sums = per.mapInPandas(partial, "view string, draw int, h1 double, n1 double, h2 double, n2 double")
    total = sums.groupBy("view", "draw").agg(*[F.sum(c).alias(c) for c in ("h1", "n1", "h2", "n2")]).where("n1 > 0 and n2 > 0")
    d = total.withColumn("d", F.col("h2") / F.col("n2") - F.col("h1") / F.col("n1"))
    return d.groupBy("view").agg(F.max(F.when(F.col("draw") < 0, F.col("d"))).alias("difference"), F.percentile(F.when(F.col("draw") >= 0, F.col("d")), F.lit(0.025)).alias("low"), F.percentile(F.when(F.col("draw") >= 0, F.col("d")), F.lit(0.975)).alias("high"))
