"""Picks that depend on the pick before: one option of each frame, chosen with the last one in view.

The options of a frame are few, so what a frame does is a small table: the pick for each possible pick before it.  Such tables compose, so a
recording is cut into blocks of frames at fixed places; a block's table is folded by itself, tables of blocks are folded again, and
the picks come back down from block to frame.  A frame whose pick is the same whatever came before has a table of one entry, and
all that follows no longer depends on what was before it.  No task holds more than a block of frames, however long a recording is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.operators.windows import KEY
from motion_tables.sources.scratch import scratch_folder

BLOCK = 256

# Fixed values of shaft picks: least length and largest distance from the grip, as shares of the image's smaller side; degrees from the
# horizontal; worth of a shaft that points up; degrees off the last shaft that halve nothing less than the least.
LEAST_LENGTH, GRIP_REACH, OFF_LEVEL = 0.15, 0.15, 20.0
UPWARD, TURN, LEAST_TEMPORAL = 0.7, 45.0, 0.3

# Fixed values of person boxes: least score, and the overlap that keeps a person.
LEAST_SCORE, SAME_PERSON = 0.5, 0.3


def first_largest(values: Column) -> Column:
    """Place of the first largest of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _after(table: Column, last: Column) -> Column:
    return F.when(F.size(table) == 1, F.get(table, F.lit(0))).otherwise(F.get(table, last))


def _composed(tables: Column) -> Column:
    """One table of an array of tables, the first applied first."""
    def then(now, t):
        return F.when(F.size(t) == 1, t).otherwise(F.transform(now, lambda i: F.get(t, i)))

    return F.aggregate(F.slice(tables, 2, F.greatest(F.size(tables) - 1, F.lit(0))), F.get(tables, F.lit(0)), then)


def _before_each(tables: Column, entry: Column) -> Column:
    """The pick before each of the tables, and the one after the last."""
    start = F.struct(entry.cast("int").alias("last"), F.array(entry.cast("int")).alias("all"))

    def step(s, t):
        now = _after(t, s["last"])
        return F.struct(now.alias("last"), F.array_append(s["all"], now).alias("all"))

    return F.aggregate(tables, start, step)["all"]


def _kept(df: DataFrame) -> DataFrame:
    """df as a table of the shared scratch folder: tables of functions are never found equal, so that Spark would work out each use of them anew."""
    spark = df.sparkSession
    at = scratch_folder(spark, "follow")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def followed(frames: DataFrame, choose: Callable[[Column, Column | None], Column], *, keeps: bool, block: int = BLOCK) -> DataFrame:
    """video_id, frame, pick (a struct of the frame's options; null where there are none).

    ``frames`` has video_id, frame (a whole number from 0, once each) and options (an array of structs, which may be empty).  ``choose(options, last)`` gives the place of the pick in
    options, with ``last`` the pick before or None.  With ``keeps`` frames without options are passed over; else they make the next frame start anew.
    """
    f = _kept(frames.select(KEY, F.col("frame").cast("long").alias("frame"), "options").withColumn("_b", F.floor(F.col("frame") / block)))
    some = f.where("size(options) > 0") if keeps else f
    ends = some.groupBy(KEY, "_b").agg(F.max_by("options", "frame").alias("_end"))
    ends = ends.select(KEY, "_b", F.lag("_end").over(Window.partitionBy(KEY).orderBy("_b")).alias("_carried"))
    own = F.lag("options").over(Window.partitionBy(KEY, "_b").orderBy("frame"))
    some = some.join(ends, [KEY, "_b"]).withColumn("_last", F.coalesce(own, "_carried")).where("size(options) > 0")
    table = F.when(F.coalesce(F.size("_last"), F.lit(0)) <= 0, F.array(choose(F.col("options"), None))).otherwise(F.transform("_last", lambda o: choose(F.col("options"), o)))
    some = some.withColumn("table", table)
    some = some.withColumn("table", F.when(F.size(F.array_distinct("table")) == 1, F.slice("table", 1, 1)).otherwise(F.col("table")))

    low = some.groupBy(KEY, "_b").agg(F.array_sort(F.collect_list(F.struct("frame", "table", "options"))).alias("s"))
    low = _kept(low.withColumn("_bb", F.floor(F.col("_b") / block)))
    middle = low.select(KEY, "_bb", "_b", _composed(F.col("s.table")).alias("table")).groupBy(KEY, "_bb").agg(F.array_sort(F.collect_list(F.struct("_b", "table"))).alias("s"))
    top = middle.select(KEY, "_bb", _composed(F.col("s.table")).alias("table")).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("_bb", "table"))).alias("s"))

    top = top.select(KEY, F.explode(F.arrays_zip(F.col("s._bb").alias("_bb"), F.slice(_before_each(F.col("s.table"), F.lit(0)), 1, F.size("s")).alias("entry"))).alias("e")).select(KEY, "e._bb", "e.entry")
    middle = middle.join(top, [KEY, "_bb"])
    middle = middle.select(KEY, F.explode(F.arrays_zip(F.col("s._b").alias("_b"), F.slice(_before_each(F.col("s.table"), F.col("entry")), 1, F.size("s")).alias("entry"))).alias("e")).select(KEY, "e._b", "e.entry")
    low = low.join(middle, [KEY, "_b"])
    picks = low.select(KEY, F.explode(F.arrays_zip(F.col("s.frame").alias("frame"), F.col("s.options").alias("options"), F.slice(_before_each(F.col("s.table"), F.col("entry")), 2, F.size("s")).alias("at"))).alias("e"))
    picks = picks.select(KEY, "e.frame", F.get("e.options", F.col("e.at")).alias("pick"))
    none = f.where("size(options) = 0").select(KEY, "frame", F.lit(None).cast(picks.schema["pick"].dataType).alias("pick"))
    return picks.unionByName(none)


def _options(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Every frame with its options (found: video_id, frame, option) in order."""
    g = found.groupBy(KEY, "frame").agg(F.array_sort(F.collect_list("option")).alias("options"))
    kind = g.schema["options"].dataType
    return frames.select(KEY, "frame").join(g, [KEY, "frame"], "left").withColumn("options", F.coalesce("options", F.array().cast(kind)))


def shaft_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """video_id, frame, x1, y1 (at the grip), x2, y2 of the shaft among a frame's line segments; null where none will do.

    ``frames``: video_id, frame, grip_x, grip_y, width, height.  ``segments``: video_id, frame, candidate (their order), x1, y1, x2, y2.
    A segment must be long enough, begin near the grip and not be level; long, upright, downward ones near the grip, turned little from the last pick, are best.
    """
    j = segments.join(frames, [KEY, "frame"])
    small = F.least("width", "height")
    first, second = F.hypot(F.col("x1") - F.col("grip_x"), F.col("y1") - F.col("grip_y")), F.hypot(F.col("x2") - F.col("grip_x"), F.col("y2") - F.col("grip_y"))
    j = j.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).withColumn("away", F.least(first, second)).withColumn("turned", second < first)
    for a, b in (("x1", "x2"), ("y1", "y2")):
        j = j.withColumn("_a", F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))).withColumn("_b", F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))).drop(a, b).withColumnsRenamed({"_a": a, "_b": b})
    j = j.withColumn("angle", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    level = F.radians(F.lit(OFF_LEVEL))
    good = (F.col("length") >= small * LEAST_LENGTH) & (F.col("away") <= small * GRIP_REACH) & (F.abs("angle") >= level) & (F.abs("angle") <= F.lit(3.141592653589793) - level)
    worth = F.col("length") * F.abs(F.sin("angle")) * F.when(F.col("y2") > F.col("y1"), 1.0).otherwise(UPWARD)
    option = F.struct("candidate", "x1", "y1", "x2", "y2", "angle", worth.alias("worth"), (F.col("away") + 1).alias("far"))
    found = j.where(good).select(KEY, "frame", option.alias("option"))

    def choose(options, last):
        def score(o):
            like = F.lit(1.0) if last is None else F.greatest(F.lit(LEAST_TEMPORAL), 1 - F.abs(o["angle"] - last["angle"]) / F.radians(F.lit(TURN)))
            return o["worth"] * like / o["far"]

        return first_largest(F.transform(options, score))

    picks = followed(_options(frames, found), choose, keeps=True)
    return picks.select(KEY, "frame", "pick.x1", "pick.y1", "pick.x2", "pick.y2")


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share over the area of both."""
    width, height = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    every = _area(a) + _area(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def _area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def person_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """video_id, frame, x0, y0, x1, y1, score of the person followed; null where no box is sure enough, and the next frame starts anew.

    ``boxes``: video_id, frame, candidate (their order), x0, y0, x1, y1, score.  The box that overlaps the last one most is kept if it does so by ``SAME_PERSON``; else the largest is taken.
    """
    found = boxes.where(F.col("score") >= LEAST_SCORE).select(KEY, "frame", F.struct("candidate", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "score")]).alias("option"))

    def choose(options, last):
        largest = first_largest(F.transform(options, _area))
        if last is None:
            return largest
        shared = F.transform(options, lambda o: overlap(o, last))
        return F.when(F.array_max(shared) >= SAME_PERSON, first_largest(shared)).otherwise(largest)

    picks = followed(_options(frames, found), choose, keeps=False)
    return picks.select(KEY, "frame", "pick.x0", "pick.y0", "pick.x1", "pick.y1", "pick.score")
