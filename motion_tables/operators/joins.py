"""Pairing, as-of, range and integrity joins.  None compares all rows with all: times are brought together by windows or time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "video_id"


def pair_views(c: DataFrame) -> DataFrame:
    """golfer, date, time, dtl, face_on of every swing with a clip of both views; the first by path of each."""
    first = lambda v: F.min(F.when(F.col("view") == v, F.col("path")))
    g = c.groupBy("golfer", "date", "time").agg(first("dtl").alias("dtl"), first("face_on").alias("face_on"))
    return g.where("dtl is not null and face_on is not null")


def unpaired(c: DataFrame) -> DataFrame:
    """Clips of swings that lack a view."""
    w = Window.partitionBy("golfer", "date", "time")
    has = lambda v: F.max((F.col("view") == v).cast("int")).over(w)
    return c.withColumn("_both", F.coalesce(has("dtl"), F.lit(0)) + F.coalesce(has("face_on"), F.lit(0))).where("_both < 2").select("path")


def partners(c: DataFrame) -> DataFrame:
    """path, partner of every clip of a known view: the first clip by path of the same swing and folder in another known view."""
    known = c.where("view is not null").withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    key = ["folder", "golfer", "date", "time"]
    first = known.groupBy(*key, "view").agg(F.min("path").alias("partner")).withColumnRenamed("view", "other")
    j = known.join(first, key).where("view <> other")
    return j.groupBy("path").agg(F.min("partner").alias("partner"))


def nearest(f: DataFrame, q: DataFrame) -> DataFrame:
    """q (video_id, id, t) with the frame of f (video_id, frame, t_ms) nearest in time, the earlier on a tie; null if the recording has none.

    Both sides are merged in one ordered window, so a recording's frames are read once however many times are asked for.
    """
    both = f.select(KEY, F.lit(None).cast("long").alias("id"), F.col("t_ms").alias("t"), "frame").unionByName(q.select(KEY, F.col("id").cast("long").alias("id"), "t").withColumn("frame", F.lit(None).cast("int")))
    here = F.when(F.col("frame").isNotNull(), F.struct("t", "frame"))
    back = Window.partitionBy(KEY).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(KEY).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    m = both.withColumn("before", F.max(here).over(back)).withColumn("after", F.min(here).over(ahead)).where("id is not null")
    first = F.col("after").isNull() | (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t"))
    return m.select(KEY, "id", "t", F.when(F.col("before").isNotNull() & first, F.col("before.frame")).otherwise(F.col("after.frame")).alias("frame"))


def nearest_within(f: DataFrame, q: DataFrame) -> DataFrame:
    """nearest, but null for a time more than half a median step before the first frame or after the last."""
    d = f.withColumn("d", F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy(KEY).orderBy("frame")))
    ends = d.groupBy(KEY).agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"), (F.coalesce(F.median("d"), F.lit(0.0)) / 2).alias("slack"))
    j = nearest(f, q).join(ends, KEY, "left")
    return j.select(KEY, "id", "t", F.when((F.col("t") >= F.col("lo") - F.col("slack")) & (F.col("t") <= F.col("hi") + F.col("slack")), F.col("frame")).alias("frame"))


def position_labels(f: DataFrame, pos: DataFrame) -> DataFrame:
    """Every frame with current (the last position at or before it) and between: the position it is, or those that it lies between."""
    j = f.select(KEY, "frame").join(pos.select(KEY, "frame", "p").groupBy(KEY, "frame").agg(F.min("p").alias("p")), [KEY, "frame"], "left")
    w = Window.partitionBy(KEY).orderBy("frame")
    j = j.withColumn("current", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("current").isNull() & F.col("_next").isNotNull(), F.concat(F.lit("before "), "_next"))
    between = between.when(F.col("_next").isNull() & F.col("current").isNotNull(), F.concat(F.lit("after "), "current")).when(F.col("current").isNotNull(), F.concat_ws("-", "current", "_next"))
    return j.select(KEY, "frame", "current", between.alias("between"))


def within_tolerance(a: DataFrame, b: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Rows of a (key, id, ts) with the row of b (key, id, ts) nearest in time, if it is within the tolerance: an equi-join on key and time bucket, b copied to three buckets."""
    width = max(1, tolerance)
    left = a.select(key, F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), F.floor(F.col("ts") / width).cast("long").alias("bucket"))
    right = b.select(key, F.col("id").alias("b_id"), F.col("ts").alias("b_ts"), F.explode(F.array(*[F.floor(F.col("ts") / width).cast("long") + k for k in (-1, 0, 1)])).alias("bucket"))
    gap = F.abs(F.col("a_ts") - F.col("b_ts"))
    j = left.join(right, [key, "bucket"]).withColumn("gap", gap).where(F.col("gap") <= tolerance)
    return j.groupBy(key, "a_id").agg(F.min(F.struct("gap", "b_id")).alias("m")).select(key, "a_id", F.col("m.b_id").alias("b_id"), F.col("m.gap").alias("gap"))


def clips(t: DataFrame, f: DataFrame, bucket_ns: int = 3600 * 10**9) -> DataFrame:
    """Frames of each trigger's session from pre_roll before it up to it, both ends included.

    The range is an equi-join on session and a time bucket of fixed width: a trigger is repeated for each bucket that its own pre-roll reaches into, a frame lies in one.
    """
    bucket = lambda c: F.floor(c / F.lit(bucket_ns)).cast("long")
    left = t.withColumn("bucket", F.explode(F.sequence(bucket(F.col("trigger_ns") - F.col("pre_roll_ns")), bucket(F.col("trigger_ns")))))
    right = f.withColumn("bucket", bucket(F.col("ts_ns")))
    return left.join(right, ["session_id", "bucket"]).where("ts_ns between trigger_ns - pre_roll_ns and trigger_ns").drop("bucket")


def clip_summary(c: DataFrame) -> DataFrame:
    """Of every clip and camera: frames, first and last time, missing numbers within, measured rate."""
    g = c.groupBy("shot_id", "camera_id", "trigger_ns", "pre_roll_ns").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), (F.max("sequence") - F.min("sequence") + 1 - F.count("*")).alias("missing"))
    span = F.col("last_ns") - F.col("first_ns")
    return g.withColumn("fps", F.when((F.col("n") > 1) & (span > 0), (F.col("n") - 1) * 1e9 / F.when(span > 0, span)))


def pre_roll(summary: DataFrame, origin_ns: int) -> DataFrame:
    """Of every shot: whether its window reaches before the session's origin, and whether each camera's clip has the whole of it."""
    start = F.greatest(F.col("trigger_ns") - F.col("pre_roll_ns"), F.lit(origin_ns))
    s = summary.withColumn("before", F.col("trigger_ns") - F.col("pre_roll_ns") < origin_ns).withColumn("full", ~F.col("before") & (F.col("first_ns") <= start))
    return s.groupBy("shot_id").agg(F.bool_or("before").alias("reaches_before_origin"), F.bool_and("full").alias("full_pre_roll"), F.count("*").alias("cameras"))


def trimmed(f: DataFrame, window: DataFrame) -> DataFrame:
    """Frames inside their recording's window, times from 0; a recording without a window stays whole, times as they are."""
    j = f.join(window.select(KEY, "start_frame", "end_frame"), KEY, "left").where("start_frame is null or frame between start_frame and end_frame")
    t0 = F.min("t_ms").over(Window.partitionBy(KEY))
    return j.withColumn("t_ms", F.when(F.col("start_frame").isNull(), F.col("t_ms")).otherwise(F.col("t_ms") - t0)).drop("start_frame", "end_frame")


def unknown_references(child: DataFrame, column: str, parent: DataFrame, id_column: str, rule: str) -> DataFrame:
    """Rows of child whose reference is not null and not an id of the parent: reference, how many, rule."""
    bad = child.where(F.col(column).isNotNull()).join(parent.select(F.col(id_column).alias(column)), column, "left_anti")
    return bad.groupBy(F.col(column).alias("reference")).agg(F.count("*").alias("n")).withColumn("rule", F.lit(rule))


def relocated(registry: DataFrame, found: DataFrame) -> DataFrame:
    """registry (id, path, sha, size) with status: ok where the path holds those bytes, relocated where another does (and which, the first), changed where the path holds others, else missing."""
    here = found.select("path", F.col("sha").alias("now"))
    where = found.groupBy("sha", "size").agg(F.min("path").alias("elsewhere"))
    j = registry.join(here, "path", "left").join(where, ["sha", "size"], "left")
    status = F.when(F.col("now") == F.col("sha"), "ok").when(F.col("elsewhere").isNotNull(), "relocated").when(F.col("now").isNotNull(), "changed").otherwise("missing")
    return j.select("id", status.alias("status"), F.when(status == "relocated", F.col("elsewhere")).alias("new_path"))
