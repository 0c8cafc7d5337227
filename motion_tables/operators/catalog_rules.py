"""The rules of a whole catalog: golfers, sources, shots with their streams, collections with their members; and what each shot may be used for.

Every rule is a condition on one table or a join of two; all violations are rows (entity, id, rule).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions.text import is_identifier


def _broken(df: DataFrame, entity: str, id_: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    return df.select(F.lit(entity).alias("entity"), id_.alias("id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("rule"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def violations(golfers: DataFrame, sources: DataFrame, shots: DataFrame, streams: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """All broken rules.  golfers (golfer_id, role); sources (source_id, golfer_id, sha256, frame_count, width, height); shots (shot_id, golfer_id, swing_type, statuses of same swing, synchronization,
    calibration and review with who and how); streams (shot_id, stream_id, source_id, start_frame, end_frame, crop_x, crop_y, crop_w, crop_h); collections (collection_id, golfer_id, status, frozen_at, frozen_by, snapshot, swing_type); members (collection_id, shot_id)."""
    known = golfers.select(F.col("golfer_id").alias("known_golfer"), "role")
    on_golfer = F.col("golfer_id") == F.col("known_golfer")
    out = [_broken(golfers, "golfer", F.col("golfer_id"), [(~is_identifier(F.col("golfer_id")), "no valid identifier")])]

    owned = sources.join(known, on_golfer, "left")
    out.append(_broken(owned, "source", F.col("source_id"), [(F.col("golfer_id").isNotNull() & F.col("known_golfer").isNull(), "unknown golfer")]))
    same = sources.groupBy("sha256").agg(F.min("source_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out.append(_broken(sources.join(same, "sha256").where("source_id <> first"), "source", F.col("source_id"), [(F.lit(True), "same bytes as another source")]))

    count = streams.groupBy("shot_id").agg(F.count("*").alias("streams"))
    s = shots.join(count, "shot_id", "left").withColumn("streams", F.coalesce("streams", F.lit(0))).join(known, on_golfer, "left")
    one, many = F.col("streams") == 1, F.col("streams") != 1
    decided = lambda p, what: [((F.col(f"{p}_status").isin("verified", "asserted", "estimated")) & (_blank(f"{p}_method") | _blank(f"{p}_by")), f"{what} decided without method or person")]
    none = lambda p: F.col(f"{p}_status") == "not_applicable"
    align, extra = F.coalesce("exposure_alignment", F.lit("unknown")), F.col("exposure_uncertainty_ms")
    out.append(_broken(s, "shot", F.col("shot_id"), [
        (F.col("known_golfer").isNull(), "unknown golfer"), (one & (~none("same") | ~none("sync")), "one stream, but not not_applicable"),
        (many & ~F.col("same_status").isin("asserted", "verified"), "several streams, but not of the same swing"), (many & (none("sync") | none("cal")), "several streams, but no synchronization or calibration"),
        (many & (F.col("sync_status") == "verified") & (F.col("same_status") != "verified"), "synchronization verified, same swing not"),
        ((F.col("uncertainty_ms") < 0), "negative uncertainty"), ((extra < 0), "negative exposure uncertainty"), ((align == "bounded") & extra.isNull(), "exposure bounded without a bound"),
        ((align != "bounded") & extra.isNotNull(), "exposure bound without being bounded"), ((align != "unknown") & ~F.col("sync_status").isin("estimated", "verified"), "exposure alignment without synchronization"),
        *decided("same", "same swing"), *decided("sync", "synchronization"), *decided("cal", "calibration"), ((F.col("review_status") != "unreviewed") & _blank("review_by"), "review without a reviewer"),
    ]))

    src = sources.select("source_id", F.col("golfer_id").alias("source_golfer"), "frame_count", "width", "height", F.lit(True).alias("there"))
    st = streams.join(src, "source_id", "left").join(shots.select("shot_id", "golfer_id"), "shot_id")
    there, id_ = F.coalesce("there", F.lit(False)), F.concat_ws("/", "shot_id", "stream_id")
    crop = F.col("crop_x").isNotNull()
    off = (F.least("crop_x", "crop_y") < 0) | (F.least("crop_w", "crop_h") < 1)
    out.append(_broken(st, "stream", id_, [
        (~there, "unknown source"), (there & (F.col("source_golfer") != F.col("golfer_id")), "source of another golfer"),
        (there & ~((F.col("start_frame") >= 0) & (F.col("start_frame") <= F.col("end_frame")) & (F.col("end_frame") < F.col("frame_count"))), "window not within the source"),
        (there & crop & off, "crop without place or size"), (there & crop & ~off & ((F.col("crop_x") + F.col("crop_w") > F.col("width")) | (F.col("crop_y") + F.col("crop_h") > F.col("height"))), "crop past the frame"),
    ]))
    twice = streams.groupBy("shot_id", "stream_id").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    out.append(twice.select(F.lit("stream").alias("entity"), id_.alias("id"), F.explode(F.array_repeat(F.lit("duplicate stream id"), F.col("n") - 1)).alias("rule")))

    c = collections.join(known, on_golfer, "left")
    frozen = [F.col(k).isNotNull() for k in ("frozen_at", "frozen_by", "snapshot")]
    out.append(_broken(c, "collection", F.col("collection_id"), [
        (F.col("known_golfer").isNull(), "unknown golfer"), (F.col("role") != "reference", "of a user"),
        ((F.col("status") == "frozen") & ~(frozen[0] & frozen[1] & frozen[2]), "frozen without provenance"), ((F.col("status") == "draft") & (frozen[0] | frozen[1] | frozen[2]), "draft with provenance"),
    ]))
    m = members.join(collections.select("collection_id", F.col("golfer_id").alias("owner"), "status", F.col("swing_type").alias("wanted")), "collection_id").join(shots.select("shot_id", "golfer_id", "swing_type"), "shot_id", "left")
    out.append(_broken(m, "member", F.concat_ws("/", "collection_id", "shot_id"), [
        (F.col("golfer_id").isNull(), "unknown shot"), (F.col("golfer_id") != F.col("owner"), "shot of another golfer"), ((F.col("status") == "draft") & (F.col("swing_type") != F.col("wanted")), "shot of another swing type"),
    ]))
    return reduce(DataFrame.unionByName, out)


def eligibility(shots: DataFrame, streams: DataFrame, sources: DataFrame) -> DataFrame:
    """shot_id, gate, eligible, reasons: what a shot may be used for.  Nothing unknown or not assessed is eligible; reasons of streams are sorted."""
    src = sources.select("source_id", "timestamps", "motion_time", "capture_fps", "basis", "variable")
    st = streams.join(src, "source_id")
    say = lambda cond, text: F.when(cond, F.concat(F.col("stream_id"), F.lit(": "), text if isinstance(text, Column) else F.lit(text)))
    real, slowed, based = F.col("motion_time") == "real_time", F.col("motion_time") == "slowed", F.col("basis").isNotNull()
    clock = F.when(real & based, None).when(slowed & based & F.col("capture_fps").isNotNull(), say(F.col("variable"), "slowed with a variable rate")).when(real, say(F.lit(True), "real time without a basis")).otherwise(say(F.lit(True), F.concat(F.lit("motion time "), F.col("motion_time"))))
    listed = lambda c: F.array_sort(F.collect_list(c))
    seen = lambda c, what: listed(say(~F.col(c).isin("good", "partial"), F.concat(F.lit(f"{what} visibility "), F.col(c))))
    g = st.groupBy("shot_id").agg(
        F.count("*").alias("n"), F.count_distinct("view").alias("views"), F.max((F.col("view") == "unknown").cast("int")).alias("unknown"),
        listed(say(F.col("timestamps") != "verified", F.concat(F.lit("timestamps "), F.col("timestamps")))).alias("times"), listed(clock).alias("clocks"),
        seen("body", "body").alias("body_landmarks"), seen("club", "club").alias("club_landmarks"), listed(say(F.col("resolution") != "yes", F.concat(F.lit("resolution "), F.col("resolution")))).alias("resolution"),
    )
    j = shots.join(g, "shot_id")
    pick = lambda *checks: F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in checks]))
    stereo = F.when(F.col("n") < 2, F.array(F.lit("one view"))).otherwise(pick(
        (F.col("same_status") != "verified", F.concat(F.lit("same swing "), F.col("same_status"))), (F.col("sync_status") != "verified", F.concat(F.lit("synchronization "), F.col("sync_status"))),
        (F.col("cal_status") != "verified", F.concat(F.lit("calibration "), F.col("cal_status"))), ((F.col("unknown") == 1) | (F.col("views") < F.col("n")), "views not distinct and known"),
    ))
    timing = F.concat("times", "clocks", pick(((F.col("n") > 1) & F.col("sync_status").isin("unknown", "not_applicable"), "no synchronization")))
    gates = {"stereo_3d": stereo, "motion_timing": timing, "body_landmarks": F.col("body_landmarks"), "club_landmarks": F.col("club_landmarks"), "resolution": F.col("resolution"), "human_review": pick((F.col("review_status") != "reviewed", F.concat(F.lit("review "), F.col("review_status"))))}
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("reasons")) for k, v in gates.items()])
    return j.select("shot_id", F.explode(rows).alias("g")).select("shot_id", "g.gate", (F.size("g.reasons") == 0).alias("eligible"), "g.reasons")


def edited_streams(streams: DataFrame, edits: DataFrame, sources: DataFrame) -> DataFrame:
    """streams (shot_id, stream_id, source_id, start_frame, end_frame, quality) after edits (shot_id, stream_id, seq, start_frame, end_frame, quality; null leaves a field) in order of seq, each as a whole on its own merits.

    Of each field the last valid edit stands.  An edit of the window must lie within the source, and of the quality be one of good, partial, bad; else all of it is refused.  Adds accepted and refused, the numbers of its edits; edits of unknown streams count nowhere.
    """
    key = ["shot_id", "stream_id"]
    own = streams.join(sources.select("source_id", "frame_count"), "source_id", "left")
    e = edits.withColumnsRenamed({"start_frame": "new_start", "end_frame": "new_end", "quality": "new_quality"}).join(own.select(*key, "frame_count"), key)
    window = F.col("new_start").isNotNull() | F.col("new_end").isNotNull()
    fits = F.coalesce((F.col("new_start") >= 0) & (F.col("new_start") <= F.col("new_end")) & (F.col("new_end") < F.col("frame_count")), F.lit(False))
    ok = (~window | fits) & (F.col("new_quality").isNull() | F.col("new_quality").isin("good", "partial", "bad"))
    e = e.withColumn("ok", ok)
    last = lambda c, cond: F.max_by(c, F.when(cond & F.col("ok"), F.col("seq")))
    g = e.groupBy(*key).agg(last("new_start", window).alias("new_start"), last("new_end", window).alias("new_end"), last("new_quality", F.col("new_quality").isNotNull()).alias("new_quality"), F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("refused"))
    j = own.join(g, key, "left")
    return j.select(*key, F.coalesce("new_start", "start_frame").alias("start_frame"), F.coalesce("new_end", "end_frame").alias("end_frame"), F.coalesce("new_quality", "quality").alias("quality"), F.coalesce("accepted", F.lit(0)).cast("long").alias("accepted"), F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))
